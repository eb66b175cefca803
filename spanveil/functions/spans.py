"""Spans as arrays of structs: finding, checking, resolving and propagating them.

Expressions are SQL text, since a whole scan is then built by a few calls to the JVM; they take and return texts of expressions.
Offsets count code points from 0, the end exclusive.  An aggregate copies its state at each element, so lists are built from runs of RUN
elements; and parts of a text are cut out of pieces of it, so that it isn't walked from its beginning for each.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import CHECKED_ENTITIES, CHECKSUM, FOLDED_FROM, FOLDED_TO, FUZZY, FUZZY_ENTITIES, IBAN_LENGTHS, STRUCTURAL

SPAN = "struct<entity_type:string,text:string,start:int,end:int,confidence:double,seq:int>"
SPANS = f"array<{SPAN}>"
PLACES = "array<struct<start:int,end:int>>"
#: Elements that one aggregate goes through; code points of a piece of text.
RUN, PIECE = 128, 4096
_names = count()


def literal(value: str) -> str:
    """A text as an SQL literal, whatever the session's rules for escapes."""
    parts = [f"r'{p}'" for p in value.split("'")]
    return parts[0] if len(parts) == 1 else "concat(" + ", chr(39), ".join(parts) + ")"


def bound(value: str, body) -> str:
    """body(name) where name stands for the value, which is computed once."""
    name = f"b{next(_names)}"
    return f"transform(array({value}), {name} -> {body(name)})[0]"


def no_spans() -> str:
    return f"cast(array() AS {SPANS})"


def span(entity: str, text: str, start: str, end: str, confidence: str | float, seq: int) -> str:
    """entity: an expression too."""
    return (
        f"named_struct('entity_type', {entity}, 'text', {text}, 'start', cast({start} AS int), 'end', cast({end} AS int), "
        f"'confidence', cast({confidence} AS double), 'seq', {seq})"
    )


def confidence_of(entity: str) -> float:
    return CHECKSUM if entity in CHECKED_ENTITIES else FUZZY if entity in FUZZY_ENTITIES else STRUCTURAL


def fold(text: Column) -> Column:
    """Look-alike letters and digits as ASCII ones, character by character."""
    return F.translate(text, FOLDED_FROM, FOLDED_TO)


def before(values: str, zero: int, both) -> str:
    """Of an array of whole numbers, for each the sum (or what else both(x, y) says) of all before it."""
    begin = f"named_struct('t', {zero}, 'out', cast(array() AS array<int>))"

    def through(elements: str, own: str, end: str = "a -> a") -> str:
        return f"aggregate({elements}, {begin}, (a, z) -> named_struct('t', {both('a.t', own)}, 'out', concat(a.out, array(a.t))), {end})"

    def runs(v: str) -> str:
        return f"transform(sequence(0, (size({v}) - 1) div {RUN}), k -> {through(f'slice({v}, k * {RUN} + 1, {RUN})', 'z')})"

    def joined(r: str) -> str:
        return f"flatten(zip_with({r}, {through(r, 'z.t', 'a -> a.out')}, (x, b) -> transform(x.out, y -> {both('y', 'b')})))"

    return bound(values, lambda v: bound(runs(v), joined))


def added(x: str, y: str) -> str:
    return f"{x} + {y}"


def larger(x: str, y: str) -> str:
    return f"greatest({x}, {y})"


def starts_of(matches: str, gaps: str) -> str:
    """Where each match starts, from the matches and the pieces of text between them."""
    lengths = f"zip_with({matches}, slice({gaps}, 1, size({matches})), (v, g) -> named_struct('gap', length(g), 'n', length(v)))"
    return bound(lengths, lambda z: f"zip_with({before(f'transform({z}, t -> t.gap + t.n)', 0, added)}, {z}, (s, t) -> s + t.gap)")


def located(matches: str, gaps: str) -> str:
    """value and start of each match."""
    return f"zip_with({matches}, {starts_of(matches, gaps)}, (v, s) -> named_struct('value', v, 'start', s))"


def pieces_of(text: str) -> str:
    """Pieces of a text for ``part``: each begins PIECE code points behind the one before it and holds twice as many."""
    return f"transform(sequence(0, length({text}) div {PIECE}), i -> substring({text}, i * {PIECE} + 1, {2 * PIECE}))"


def part(text: str, pieces: str, start: str, n: str) -> str:
    """n code points of the text from start on."""
    return f"if(({n}) > {PIECE}, substring({text}, ({start}) + 1, {n}), substring({pieces}[cast(({start}) div {PIECE} AS int)], cast(({start}) % {PIECE} AS int) + 1, {n}))"


def luhn(value: str) -> str:
    digits = f"regexp_replace({value}, '[^0-9]', '')"
    return f"(length({digits}) >= 12 AND luhn_check({digits}))"


def tc_id(value: str) -> str:
    d = [f"try_cast(substring({value}, {k + 1}, 1) AS int)" for k in range(11)]
    odd, even = " + ".join(d[0:9:2]), " + ".join(d[1:8:2])
    return f"(length({value}) = 11 AND pmod(({odd}) * 7 - ({even}), 10) = {d[9]} AND pmod({odd} + {even} + {d[9]}, 10) = {d[10]})"


def _country_lengths() -> str:
    return "map(" + ", ".join(f"'{k}', {n}" for k, n in IBAN_LENGTHS.items()) + ")"


def _valid_number(clean: str) -> str:
    """Of capitals and digits without separators: known country and remainder 1 modulo 97, nine digits at a time; the country's length isn't asked for."""
    known = f"substring({clean}, 1, 2) IN ({', '.join(repr(k) for k in IBAN_LENGTHS)})"
    turned = f"concat(substring({clean}, 5), substring({clean}, 1, 4))"
    digits = f"array_join(transform(split({turned}, ''), x -> if(x <= '9', x, cast(ascii(x) - 55 AS string))), '')"

    def remainder(d: str) -> str:
        return f"aggregate(sequence(1, length({d}), 9), cast(0 AS bigint), (r, i) -> try_cast(concat(cast(r AS string), substring({d}, i, 9)) AS bigint) % 97)"

    return f"(length({clean}) >= 5 AND {known} AND {clean} RLIKE '^[0-9A-Z]+$' AND {bound(digits, remainder)} = 1)"


def iban(value: str) -> str:
    return f"coalesce({bound(f"upper(replace({value}, ' ', ''))", _valid_number)}, false)"


def iban_run(value: str) -> str:
    """(start, end) of each IBAN of a run without separators; empty unless the run splits exactly into two or more valid ones."""

    def split_up(clean: str) -> str:
        def peel(n: str) -> str:
            whole = f"{n} IS NOT NULL AND s.pos + {n} <= length({clean}) AND {iban(f'substring({clean}, s.pos + 1, {n})')}"
            good = f"named_struct('pos', s.pos + {n}, 'ok', true, 'out', concat(s.out, array(named_struct('start', s.pos, 'end', s.pos + {n}))))"
            return f"if({whole}, {good}, named_struct('pos', s.pos, 'ok', false, 'out', s.out))"

        step = bound(f"try_element_at({_country_lengths()}, substring({clean}, s.pos + 1, 2))", peel)
        begin = f"named_struct('pos', 0, 'ok', true, 'out', cast(array() AS {PLACES}))"
        done = f"aggregate(sequence(1, 8), {begin}, (s, k) -> if(s.ok AND s.pos < length({clean}), {step}, s))"
        return bound(done, lambda d: f"if({d}.ok AND {d}.pos = length({clean}) AND size({d}.out) >= 2, {d}.out, cast(array() AS {PLACES}))")

    # no two numbers are shorter together
    least = 2 * min(IBAN_LENGTHS.values())
    return f"if(length({value}) < {least}, cast(array() AS {PLACES}), {bound(f'upper({value})', split_up)})"


def _greedy(cluster: str) -> str:
    """Of spans that touch: by confidence, then length, then start, then order; sorted by start."""
    ranked = f"sort_array(transform({cluster}, t -> named_struct('c', -t.confidence, 'n', t.start - t.end, 'a', t.start, 'q', t.seq, 't', t)))"
    free = "forall(kept, k -> r.t.start >= k.end OR k.start >= r.t.end)"
    kept = f"aggregate({ranked}, {no_spans()}, (kept, r) -> if({free}, concat(kept, array(r.t)), kept))"
    return f"transform(sort_array(transform({kept}, t -> named_struct('a', t.start, 't', t))), r -> r.t)"


def resolve(spans: str) -> str:
    """A set without overlaps: by confidence, then length, then start, then order; sorted by start.

    Only spans that touch, directly or through others, can rule each other out: such clusters are resolved one by one.
    """

    def clustered(by_start: str) -> str:
        reached = before(f"transform({by_start}, x -> x.end)", -1, larger)
        firsts = bound(reached, lambda r: f"filter(sequence(0, size({by_start}) - 1), i -> {by_start}[i].start >= {r}[i])")
        slices = bound(firsts, lambda f: f"zip_with({f}, concat(slice({f}, 2, size({f})), array(size({by_start}))), (i, j) -> transform(slice({by_start}, i + 1, j - i), x -> x.s))")
        apart = f"forall(zip_with({by_start}, slice({by_start}, 2, size({by_start})), (x, y) -> y IS NULL OR y.start >= x.end), ok -> ok)"
        return f"if({apart}, transform({by_start}, x -> x.s), flatten(transform({slices}, c -> if(size(c) = 1, c, {_greedy('c')}))))"

    by_start = f"sort_array(transform({spans}, s -> named_struct('start', s.start, 'end', s.end, 's', s)))"
    return f"if(size({spans}) <= 1, {spans}, {bound(by_start, clustered)})"


def value_spans(text: str, value: str, entity: str, seq: int) -> str:
    """Every occurrence of a denied value, overlapping ones too."""
    n, quoted = len(value), literal("(?=\\Q" + value.replace("\\E", "\\E\\\\E\\Q") + "\\E)")
    found = f"split({text}, {quoted}, -1)"

    def at(pieces: str) -> str:
        # a piece but the first begins where the value does; the first may, too
        starts = before(f"transform({pieces}, p -> length(p))", 0, added)
        kept = f"filter({starts}, (s, i) -> i > 0 OR startswith({text}, {literal(value)}))"
        return f"transform({kept}, s -> {span(literal(entity), literal(value), 's', f's + {n}', CHECKSUM, seq)})"

    return f"if(contains({text}, {literal(value)}), {bound(found, at)}, {no_spans()})"


def allowed_removed(spans: str, allowlist: list[str]) -> str:
    return f"filter({spans}, s -> NOT array_contains(array({', '.join(literal(a) for a in allowlist)}), s.text))" if allowlist else spans


def propagate(spans: str, text: str, min_length: int) -> str:
    """Adds the other occurrences of each found value that no letter or digit touches, and resolves again."""
    # of equal values the surest, then the first found stands for all
    listed = f"sort_array(transform(filter({spans}, s -> length(s.text) >= {min_length}), (s, i) -> named_struct('text', s.text, 'less', -s.confidence, 'i', i, 's', s)))"
    best = bound(listed, lambda r: f"transform(filter({r}, (x, i) -> i = 0 OR {r}[i - 1].text != x.text), x -> x.s)")
    quoted = r"concat(r'\Q', replace(v.text, r'\E', r'\E\\E\Q'), r'\E')"

    def elsewhere(gaps: str) -> str:
        letter = r"RLIKE r'^[\p{L}\p{N}]$'"
        # where nothing lies between two occurrences, they touch each other
        last = f"if({gaps}[i] != '', right({gaps}[i], 1), if(i > 0, right(v.text, 1), ''))"
        first = f"if({gaps}[i + 1] != '', left({gaps}[i + 1], 1), if(i + 2 < size({gaps}), left(v.text, 1), ''))"
        starts = starts_of(f"array_repeat(v.text, size({gaps}) - 1)", gaps)
        free = bound(starts, lambda at: f"transform(filter(sequence(0, size({gaps}) - 2), i -> NOT {last} {letter} AND NOT {first} {letter}), i -> {at}[i])")
        known = f"transform(filter({spans}, k -> k.end - k.start = length(v.text)), k -> k.start)"
        made = f"transform(array_except({free}, {known}), p -> {span('v.entity_type', 'v.text', 'p', 'p + length(v.text)', 'v.confidence', 1 << 20)})"
        return f"if(size({gaps}) < 2, {no_spans()}, {made})"

    extra = f"flatten(transform({best}, v -> {bound(f'split({text}, {quoted}, -1)', elsewhere)}))"
    return f"if(size({spans}) = 0, {spans}, {bound(f'concat({spans}, {extra})', resolve)})"
