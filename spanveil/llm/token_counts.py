"""Token counts by a finite-state machine compiled from a byte-pair vocabulary.

In a byte-pair encoding the last token of a text's every prefix is determined: it is the one vocabulary
piece that ends there and forms a valid pair with the last token before it.  What can still
change later depends only on the suffixes of the prefix that begin some longer piece.  So the machine's state is
the list of those suffixes, each with the token before it and with the count of tokens up to it
relative to the whole; a transition reads a character and emits the change of the count.  The states and
transitions inside every piece of the vocabulary are compiled before the first text.  Those between pieces have no bound but the texts, so
they are compiled when first reached; beyond a bound of states all is compiled anew.

Texts of every length are read in chunks.  No piece goes on over the edge before a run of word marks, so from such an edge
on every start state leads to the same one: a chunk's map is its unsynchronised head, the count of what
follows and its end state.  Maps compose associatively, and are composed in a balanced scan.  The
maps of single words, which stand between edges and so are plain counts, are remembered.

Defined results: null and empty texts have 0 tokens; repeated rows are counted each on its own; a null doc_id is kept; an empty
table gives no rows.  A text of any length is held once; the machine reads it chunk by chunk.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_batch, read_table, texts_of, tokenizer_path

TOKENIZER = "piece_bpe_32k.model"
LIMIT = 4096
MARK = "▁"
#: Characters in a chunk.
CHUNK = 1 << 16


class Machine:
    """A transducer for a sentencepiece BPE model with byte fallback. keep: the most states, pairs or words kept."""

    def __init__(self, path: str, keep: int = 300_000):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.keep = keep
        size = self.library.vocab_size()
        plain = [i for i in range(size) if not (self.library.is_control(i) or self.library.is_byte(i) or self.library.is_unknown(i) or self.library.is_unused(i))]
        texts = [self.library.id_to_piece(i) for i in plain]
        # a newline is no piece of its own, so nothing merges over it
        alone = self.library.encode(["\n" + t for t in texts])
        self.ids = {t: i for t, i, got in zip(texts, plain, alone, strict=True) if got[2:] == [i]}
        self.begins = {t[:k] for t in self.ids for k in range(1, len(t))}
        self.texts = {i: t for t, i in self.ids.items()}
        self.words: dict[str, int] = {}
        self._compile()

    def _compile(self) -> None:
        """The machine of the vocabulary's pieces, of at most half the states kept. The start state is 0: nothing before it can merge with what follows."""
        self.states: list[tuple] = [(("", -1, 0),)]
        self.numbers = {self.states[0]: 0}
        self.moves: list[dict[str, tuple[int, int]]] = [{}]
        self.pairs: dict[tuple[int, int], bool] = {}
        for text in self.ids:
            if 2 * len(self.states) > self.keep:
                break
            self.run(text)

    def _pair(self, a: int, b: int) -> bool:
        """Whether a and b stay apart when they stand side by side."""
        if a < 0:
            return True
        if (known := self.pairs.get((a, b))) is None:
            known = self.pairs[a, b] = self.library.encode("\n" + self.texts[a] + self.texts[b])[2:] == [a, b]
        return known

    def _move(self, state: int, c: str) -> tuple[int, int]:
        """Compiles the transition from a state by a character: the next state and the tokens emitted."""
        if c not in self.ids:  # its bytes; nothing merges over them
            found = (0, len(c.encode("utf-8", "surrogatepass")))
        else:
            last, total = None, 0
            for suffix, before, count in self.states[state]:
                piece = self.ids.get(suffix + c)
                if piece is not None and self._pair(before, piece):
                    last, total = piece, count + 1
                    break
            if last is None:
                raise AssertionError("no valid last token")
            chain = tuple((s + c, before, count - total) for s, before, count in self.states[state] if s + c in self.begins)
            key = (*chain, ("", last, 0)) if chain else (("", last, 0),)
            number = self.numbers.get(key)
            if number is None:
                number = self.numbers[key] = len(self.states)
                self.states.append(key)
                self.moves.append({})
            found = (number, total)
        self.moves[state][c] = found
        return found

    def run(self, text: str, state: int = 0) -> tuple[int, int]:
        """The end state and the tokens emitted."""
        moves, total = self.moves, 0
        for c in text:
            move = moves[state].get(c)
            if move is None:
                move = self._move(state, c)
            state = move[0]
            total += move[1]
        return state, total

    def word(self, text: str) -> int:
        """Tokens of a text that stands between edges over which nothing merges."""
        n = self.words.get(text)
        if n is None:
            if len(self.states) > self.keep or len(self.pairs) > 4 * self.keep:
                self._compile()
            n = self.run(text)[1]
            if len(self.words) > self.keep:
                self.words.clear()
            if len(text) <= 64:
                self.words[text] = n
        return n

    def chunk(self, text: str) -> tuple[str, int | None, str]:
        """A chunk's map: (head, count, tail). From any state it reads the head, then adds the count, and ends in
        the state that the tail leads to from the start. count None: no edge inside, all of it is head."""
        edge = next((i for i in range(1, len(text)) if text[i] == MARK != text[i - 1]), None)
        if edge is None:
            return text, None, ""
        end = next(i for i in range(len(text) - 1, 0, -1) if text[i] == MARK != text[i - 1])
        return text[:edge], self._between(text[edge:end]), text[end:]

    def _between(self, text: str) -> int:
        """Tokens of a text that begins and ends at edges."""
        if not text:
            return 0
        parts = text[1:].split(MARK)
        if "" not in parts:
            word, known = self.word, self.words
            try:
                return sum(map(known.__getitem__, parts))
            except KeyError:
                return sum(self._marked(p) for p in parts)
        total, marks = 0, 1
        for k, p in enumerate(parts):
            if p:
                total += self._marked(p) if marks == 1 else self.word(MARK * marks + p)
                marks = 1
            elif k < len(parts) - 1:
                marks += 1
            else:
                total += self.word(MARK * marks)
        return total

    def _marked(self, part: str) -> int:
        """Tokens of a mark and a word; remembered under the word alone, which no mark begins."""
        n = self.words.get(part)
        if n is None:
            n = self.word(MARK + part)
            if len(part) <= 64:
                self.words[part] = n
        return n

    def join(self, a: tuple[str, int | None, str], b: tuple[str, int | None, str]) -> tuple[str, int | None, str]:
        """The map of chunk a followed by chunk b."""
        if a[1] is None and b[1] is None:
            return self.chunk(a[0] + b[0])
        if a[1] is None:
            head, n, _ = self.chunk(a[0] + b[0])
            return (a[0] + b[0], b[1], b[2]) if n is None else self._head(a[0] + b[0], b)
        if b[1] is None:
            head, n, tail = self._split(a[2] + b[0])
            return a[0], a[1] + n, tail
        _, n, tail = self._split(a[2] + b[0])
        return a[0], a[1] + n + self._whole(tail) + b[1], b[2]

    def _head(self, text: str, b: tuple) -> tuple[str, int | None, str]:
        head, n, tail = self.chunk(text)
        return head, n + self._whole(tail) + b[1], b[2]

    def _split(self, text: str) -> tuple[str, int, str]:
        """Of a text that begins at an edge: what is settled, and the tail from its last edge on."""
        end = next((i for i in range(len(text) - 1, 0, -1) if text[i] == MARK != text[i - 1]), 0)
        return "", self._between(text[:end]), text[end:]

    def _whole(self, text: str) -> int:
        return self._between(text) if text[:1] == MARK else self.run(text)[1]

    def count(self, text: str, chunk: int = CHUNK) -> int:
        if not text:
            return 0
        text = MARK + text.replace(" ", MARK)
        maps = [self.chunk(text[i : i + chunk]) for i in range(0, len(text), chunk)]
        while len(maps) > 1:
            maps = [self.join(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, n, tail = maps[0]
        return self._whole(head) + (n or 0) + (self._whole(tail) if tail else 0)


@lru_cache(maxsize=2)
def machine(path: str) -> Machine:
    return Machine(path)


def count_tokens(docs: DataFrame, model: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether they are more than the limit, for each row."""
    path = model or tokenizer_path(TOKENIZER)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        count = machine(path).count
        return pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_bytes": pdf["n_bytes"], "n_tokens": [count(t) for t in pdf["text"]]})

    table = texts_of(docs).select(F.col("doc_id").cast("long"), F.octet_length("text").cast("long").alias("n_bytes"), "text")
    return table.mapInPandas(per_batch(run), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"))
