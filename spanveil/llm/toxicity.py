"""Toxicity by a weighted lexicon that Aho-Corasick finds in folded text.

Folding: compatibility forms as what they stand for, without stray marks and invisible signs; lower case, look-alike letters of other scripts
(capitals by the look of the capital) and full-width forms to Latin ones, and digits and signs that stand for letters to those letters; a 1 is read as i
and as l, a ! before a letter as i and as itself.  Lexicon entries are beginnings of words or whole words, each with a weight; a match whose
surroundings make up an exception phrase doesn't count.  The summed weight, also divided by the length in words, gives the
score through a logistic function.

The lexicon is learned from labelled rows: entries are the word beginnings that cover the toxic rows and hardly
occur in clean ones, chosen greedily, each for the rows that the earlier ones leave; weights are log odds, so
that a beginning that clean words share too counts little and tells by how often it comes.
At most SAMPLE labelled rows are used, those with the least hash of doc_id; near copies among them count once, the one with the least doc_id.
All choices depend on rows and not on how they are dealt out.
The scores themselves cover every row and whole texts.

Defined results: null and empty texts score like a text without a match; labels with null are ignored, of
repeated labels the largest counts; without any toxic label all scores are 0; repeated rows score alike; a null doc_id
is kept and not held out; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
import unicodedata
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, per_batch, read_table, texts_of

#: The most labelled rows that the lexicon is learned from; they bound its entries and exception phrases too.
SAMPLE = 20_000
THRESHOLD = 0.7
#: Lengths of word beginnings; the share of new toxic rows, and how rare in clean rows, an entry must be.
SHORTEST, LONGEST, LEAST_ROWS, LEAST_SHARE, CLEAN_RATIO = 4, 8, 3, 0.002, 0.15
#: Labelled rows that agree in so many of their least three-word hashes are near copies.
COMPARED = 3
#: A toxic row asks for entries until their weights come to so much.
ENOUGH = 6.0

# Letters of other scripts that look like Latin ones, and signs that stand for letters.
LOOKALIKES = str.maketrans("асеорхуіјѕһԁԛԝʏαοερτυνικкмтнвβχζημ01345789@", "aceopxyijshdqwyaoeptuvikkmthbbxznuoieastbga")
LOOKALIKES |= {0xFF41 + k: 97 + k for k in range(26)}
CAPITALS = str.maketrans("АВЕКМНОРСТУХІЈЅҺԚԜΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "abekmhopctyxijshqwabezhikmnoptyx")
CAPITAL = re.compile("[" + "".join(map(chr, CAPITALS)) + "]")
DOLLAR = re.compile(r"\$(?=\w)")
BAR = re.compile(r"(?<=\w)\|(?=\w)")
# Marks that stand on nothing they could be joined with, and signs that can't be seen.
STRAY = re.compile("[\u0300-\u036f\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
MARK = re.compile(r"!(?=\w)")
WORD = re.compile(r"\w+")


def visible(text: str) -> str:
    """Compatibility forms as what they stand for, without stray marks and invisible signs."""
    if text.isascii():
        return text
    if not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    return STRAY.sub("", text)


def lower(text: str) -> str:
    return (CAPITAL.sub(lambda m: m.group().translate(CAPITALS), text) if not text.isascii() else text).lower()


def fold(text: str) -> str:
    text = lower(text)
    if "$" in text:
        text = DOLLAR.sub("s", text)
    if "|" in text:
        text = BAR.sub("l", text)
    return text.translate(LOOKALIKES)


@dataclass(frozen=True)
class Lexicon:
    """weights: by beginning of a word, or by whole word with a $ behind it. exceptions: pairs of folded words; a match in one of
    them doesn't count. curve: of 1, the logarithm of the weight and of the weight in a hundred words."""

    weights: dict[str, float]
    exceptions: frozenset[tuple[str, str]] = frozenset()
    curve: tuple[float, float, float] = (-30.0, 0.0, 0.0)
    automaton: list = field(default_factory=list, compare=False)

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "exceptions": self.exceptions, "curve": self.curve, "automaton": []}

    def matches(self, folded: str, text: str = "") -> list[tuple[int, int, str]]:
        """(start, end, entry) of entries that stand at a word's beginning, the longest at each place. text: what was folded, for the other readings
        of 1 and !."""
        if not self.weights:
            return []
        if not self.automaton:
            import ahocorasick

            # the second one finds entries whose i and l are alike
            for alike in (False, True):
                a = ahocorasick.Automaton()
                for w in self.weights:
                    key = w.rstrip("$").replace("l", "i") if alike else w.rstrip("$")
                    a.add_word(key, (len(key), [w])) if key not in a else a.get(key)[1].append(w)
                a.make_automaton()
                self.automaton.append(a)
        found: dict[int, tuple[int, str]] = {}

        def search(automaton, searched: str, shown: str, source: str) -> None:
            for last, (n, entries) in automaton.iter(searched):
                start = last + 1 - n
                if start and (shown[start - 1].isalnum() or shown[start - 1] == "_"):
                    continue
                whole = last + 1 == len(shown) or not shown[last + 1].isalnum()
                for w in entries:
                    if source and any(c != shown[start + k] and not (c == "l" and source[start + k] == "1") for k, c in enumerate(w.rstrip("$"))):
                        continue
                    if (whole or w[-1] != "$") and (start not in found or n >= found[start][0] - start):
                        found[start] = (last + 1, w)

        search(self.automaton[0], folded, folded, "")
        if "1" in text or MARK.search(text):
            shown = fold(MARK.sub("i", text))
            search(self.automaton[1], shown.replace("l", "i"), shown, lower(text))
        return [(s, e, w) for s, (e, w) in sorted(found.items())]

    @staticmethod
    def around(folded: str, start: int) -> tuple[str, str, str]:
        """The word before, the word itself and the word after, whole."""
        here = WORD.match(folded, start)
        end = here.end() if here else start + 1  # a ! read as a letter
        after = WORD.search(folded, end)
        last = start - 1
        while last >= 0 and not is_letter(folded[last]):
            last -= 1
        first = last
        while first >= 0 and is_letter(folded[first]):
            first -= 1
        return folded[first + 1 : last + 1], here.group() if here else folded[start], after.group() if after else ""

    def weigh(self, text: str) -> tuple[float, int, int]:
        """The summed weight, the matches that count, and the words."""
        text = visible(text)
        folded, total, hits = fold(text), 0.0, 0
        for start, _, w in self.matches(folded, text):
            if self.exceptions:
                a, b, c = self.around(folded, start)
                if (a, b) in self.exceptions or (b, c) in self.exceptions:
                    continue
            total += self.weights[w]
            hits += 1
        return total, hits, len(text.split())

    def score(self, total: float, words: int) -> float:
        x = sum(a * b for a, b in zip(self.curve, shape(total, words), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def shape(total: float, words: int) -> tuple[float, float, float]:
    return 1.0, math.log1p(max(total, 0.0)), math.log1p(100 * max(total, 0.0) / max(words, 1))


def is_letter(c: str) -> bool:
    return c.isalnum() or c == "_"


def beginnings(word: str) -> list[str]:
    return [word[:k] for k in range(SHORTEST, min(LONGEST, len(word)) + 1)] + [word + "$"]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """toxic and the distinct folded words, with the text, of a bounded number of labelled rows; near copies once."""
    chosen = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).dropna().filter(~held_out(F.col("doc_id")))
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for doc_id, toxic, text in zip(pdf["doc_id"], pdf["toxic"], pdf["text"], strict=True):
            words = WORD.findall(fold(visible(text)))
            signs = {zlib.crc32(" ".join(words[i : i + 3]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(words) - 2))}
            rows.append((doc_id, toxic, " ".join(f"{x:08x}" for x in heapq.nsmallest(COMPARED, signs)), " ".join(sorted(set(words))), text))
        return pd.DataFrame(rows, columns=["doc_id", "toxic", "sign", "words", "text"])

    joined = texts_of(docs).select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")
    rows = joined.mapInPandas(per_batch(run), "doc_id long, toxic int, sign string, words string, text string")
    one = rows.groupBy("toxic", "sign").agg(F.min(F.struct("doc_id", "text", "words")).alias("first"))
    return cut(one.select("toxic", "first.words", "first.text"), "labelled")


def learn(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, exceptions: tuple[tuple[str, str], ...] = ()) -> Lexicon:
    sample = labelled_sample(docs, labels, most)
    toxic = [set().union(*map(beginnings, r[0].split())) for r in sample.filter("toxic = 1").select("words").toLocalIterator()]
    n_clean = sample.filter("toxic = 0").count()
    if not toxic:
        return Lexicon({})
    least = max(1, min(LEAST_ROWS, len(toxic) // 4), LEAST_SHARE * len(toxic))
    counts = {f: n for f, n in Counter(f for s in toxic for f in s).items() if n >= least}

    def clean(pdf: pd.DataFrame) -> pd.DataFrame:
        seen = Counter(f for words in pdf["words"] for f in {b for w in words.split() for b in beginnings(w)} if f in counts)
        return pd.DataFrame({"entry": list(seen.keys()), "n": list(seen.values())})

    in_clean = dict(sample.filter("toxic = 0").select("words").mapInPandas(per_batch(clean), "entry string, n long").groupBy("entry").agg(F.sum("n")).collect())
    rare = {f for f, n in counts.items() if in_clean.get(f, 0) / max(n_clean, 1) <= CLEAN_RATIO * n / len(toxic)}
    # of beginnings that the same rows have, only the longest
    rare -= {f[:-1] for f in rare if (counts[f], in_clean.get(f, 0)) == (counts.get(f[:-1]), in_clean.get(f[:-1], 0))}
    weight = {f: math.log((counts[f] + 0.5) / (len(toxic) + 1)) - math.log((in_clean.get(f, 0) + 0.5) / (n_clean + 1)) for f in rare}
    left, chosen = [s & rare for s in toxic], {}
    active = Counter(f for s in left for f in s)
    rows_of: dict[str, list[int]] = {}
    for i, s in enumerate(left):
        for f in s:
            rows_of.setdefault(f, []).append(i)
    wanted = [ENOUGH] * len(left)
    while active:
        # of equal gains the longest beginning, the surest one
        entry = max(active, key=lambda f: (active[f] * weight[f], len(f), f))
        if active[entry] < least:
            break
        chosen[entry] = weight[entry]
        for i in rows_of[entry]:
            if wanted[i] > 0:
                wanted[i] -= weight[entry]
                if wanted[i] <= 0:
                    for f in left[i]:
                        active[f] -= 1
        del active[entry]
    lexicon = Lexicon(chosen, frozenset(exceptions))

    def context(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for label, text in zip(pdf["toxic"], pdf["text"], strict=True):
            text = visible(text)
            total, hits, words = lexicon.weigh(text)
            pairs: set[tuple[str, str]] = set()
            if hits:
                folded = fold(text)
                for start, _, _ in lexicon.matches(folded, text):
                    a, b, c = lexicon.around(folded, start)
                    pairs |= {(a, b), (b, c)}
            rows.append((int(label), total, words, [list(p) for p in pairs]))
        return pd.DataFrame(rows, columns=["toxic", "total", "words", "pairs"])

    seen = cut(sample.select("toxic", "text").mapInPandas(per_batch(context), "toxic int, total double, words long, pairs array<array<string>>"), "context")
    # phrases that clean rows use and toxic ones don't
    phrases = seen.select("toxic", F.explode("pairs").alias("p")).groupBy("p").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n")).filter("bad = 0 AND n >= 8 AND p[0] != '' AND p[1] != ''")
    learned = frozenset(tuple(r[0]) for r in phrases.select("p").collect())
    points = seen.select("toxic", "total", "words").toPandas().sort_values(["toxic", "total", "words"])
    curve = fit(np.asarray([shape(t, w) for t, w in zip(points["total"], points["words"], strict=True)]), points["toxic"].to_numpy(dtype=float))
    return Lexicon(chosen, lexicon.exceptions | learned, curve)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float, float]:
    """Logistic regression by Newton's method, with a slight pull to zero."""
    a = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        slope = x.T @ (p - y) + ridge * a
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(a))
        step = np.linalg.solve(curve, slope)
        a -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in a)


def scorer(lexicon: Lexicon):
    """A function of a text column: score and matches."""

    @F.pandas_udf("score double, hits int")
    def score(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            total, hits, words = lexicon.weigh(text or "")
            rows.append((lexicon.score(total, words) if lexicon.weights else 0.0, hits))
        return pd.DataFrame(rows, columns=["score", "hits"])

    return score


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted and the number of matches of each row."""
    score = scorer(learn(docs, labels))
    table = texts_of(docs).select(F.col("doc_id").cast("long"), score("text").alias("s"))
    return table.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "s.score", (F.col("s.score") >= threshold).cast("int").alias("predicted"), "s.hits")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns."""
    score = scorer(learn(docs, labels))
    return docs.filter(score(F.coalesce("text", F.lit("")))["score"] < threshold)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
