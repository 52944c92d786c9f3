"""Operator 12: secret scans, by patterns and by the entropy of sliding windows, in DataFrame functions alone.

Three kinds of base findings are matches of fixed patterns (``assign``, ``access``, ``hex``). The method adds spans of
high entropy: runs of one character class (hexadecimal digits, base64 signs) are candidate strings; a window of
``WINDOW`` signs slides over each, its symbols' counts and the sum of c * log2(c) are changed by the sign that enters and the
one that leaves, and windows whose Shannon entropy reaches the class's threshold are joined to spans. Spans that an
allow-list pattern matches (placeholders, words) and spans within a base finding are left out; base findings always stay.

Everything happens within a row: no shuffle, no Python. A run is scanned in blocks of ``BLOCK`` windows and positions are
summed in chunks, so that work grows with the length of a text, not with its square. Sums of entropies are whole
numbers (c * log2(c) by 2^20, rounded), so that nothing drifts.

Null texts are empty texts and have no spans, as have texts without a match; a row's result depends on its text
alone, so repeated rows repeat their result and a null doc_id stays null; an empty table gives no rows; other columns
are not read. Positions are in code points, ends exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds, patterns (Java's notation; the keyword in either case) and least lengths of the base findings.
KINDS = ("assign", "access", "hex")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

#: Signs of a window; classes: kind, pattern of a sign, its symbols in order, least bits a sign. Hexadecimal letters count in either case.
WINDOW = 24
CLASSES = (
    ("entropy_hex", "[0-9A-Fa-f]", "0123456789abcdef", 3.2),
    ("entropy_base64", "[A-Za-z0-9+/_=-]", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 4.1),
)
#: Spans that are no secrets: placeholders, repeated signs, paths and slugs of words in one case.
ALLOWED = (r"(?i)example|sample|placeholder|changeme|dummy|your", r"(?i)0{6}|x{6}|-{6}", r"^[a-z/_=-]+$", r"^[A-Z/_=-]+$")
SCALE, BLOCK, CHUNK = 1 << 20, 4096, 1024


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _before(lengths: Column) -> Column:
    """Sum of the lengths before each, summed by chunks so that no long array is copied at every step."""
    add = lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x))
    start = F.array(F.lit(0).cast("long"))
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(lengths) - 1, F.lit(0)), F.lit(CHUNK)), lambda c: F.aggregate(F.slice(lengths, c + 1, CHUNK), start, add))
    return _let(chunks, lambda every: F.flatten(F.zip_with(every, F.slice(F.aggregate(every, start, lambda sums, x: add(sums, F.element_at(x, -1))), 1, F.size(every)), lambda sums, base: F.transform(F.slice(sums, 1, F.greatest(F.size(sums) - 1, F.lit(0))), lambda x: x + base))))


def matches(text: Column, pattern: str, group: int | None = None) -> Column:
    """array<struct<start, end, found, value>> of all leftmost matches: pieces between them give their places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = found if group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("found"), value.alias("value"))
    some = _let(
        F.filter(parts, lambda p: p["found"].isNotNull()),
        lambda rows: F.zip_with(
            rows,
            _before(F.transform(rows, lambda p: (F.length(p["gap"]) + F.length(p["found"])).cast("long"))),
            lambda p, at: F.struct((at + F.length(p["gap"])).alias("start"), (at + F.length(p["gap"]) + F.length(p["found"])).alias("end"), p["found"].alias("found"), p["value"].alias("value")),
        ),
    )
    none = F.array().cast("array<struct<start:bigint,end:bigint,found:string,value:string>>")
    return F.when(text.rlike(pattern), some).otherwise(none)


def _shaped(kind: int, rows: Column) -> Column:
    return F.transform(rows, lambda m: F.struct(m["start"].cast("long").alias("start"), F.lit(kind).alias("kind"), m["end"].cast("long").alias("end")))


def base_spans(text: Column) -> Column:
    """array<struct<start, kind (its place in KINDS), end>> of the base findings, in order."""
    assign = F.filter(matches(text, ASSIGN, 1), lambda m: F.length(m["value"]) >= ASSIGN_LEAST)
    return F.array_sort(F.concat(_shaped(0, assign), _shaped(1, matches(text, ACCESS)), _shaped(2, matches(text, HEX))))


def _weights() -> list[int]:
    """c * log2(c) of counts 0 to WINDOW, by SCALE."""
    return [round(c * math.log2(c) * SCALE) if c else 0 for c in range(WINDOW + 1)]


def _slide(codes: Column, first: Column, symbols: int, most: int) -> Column:
    """array<struct<start, end>>: joined windows of high entropy among those that begin in the block at ``first``.

    Each step of the fold lets one sign leave or enter: even steps take the sign WINDOW back away, odd ones add one.
    """
    weight = F.array(*[F.lit(x).cast("long") for x in _weights()])
    span = "struct<start:int,end:int>"
    state = F.struct(F.array_repeat(F.lit(0), symbols).alias("counts"), F.lit(0).cast("long").alias("sum"), F.lit(None).cast(span).alias("open"), F.array().cast(f"array<{span}>").alias("done"))
    last = F.least(F.size(codes), first + BLOCK + WINDOW - 1) - 1

    def step(now: Column, t: Column) -> Column:
        at = first + F.floor(t / 2).cast("int")
        enters = t % 2 == 1
        place = F.when(enters, at).otherwise(at - WINDOW)
        code, by = codes[place], F.when(enters, F.lit(1)).otherwise(F.lit(-1))
        begin = at - (WINDOW - 1)

        def moved(count: Column) -> Column:
            total = now["sum"] + F.element_at(weight, count + by + 1) - F.element_at(weight, count + 1)
            counts = F.concat(F.slice(now["counts"], 1, code - 1), F.array(count + by), F.slice(now["counts"], code + 1, symbols))
            high = enters & (begin >= first) & (total <= most)
            joins = high & now["open"].isNotNull() & (begin <= now["open"]["end"])
            fresh = F.struct(begin.alias("start"), (at + 1).alias("end"))
            open_ = F.when(joins, F.struct(now["open"]["start"].alias("start"), (at + 1).alias("end"))).when(high, fresh).otherwise(now["open"])
            done = F.when(high & ~joins & now["open"].isNotNull(), F.concat(now["done"], F.array(now["open"]))).otherwise(now["done"])
            return F.struct(counts.alias("counts"), total.alias("sum"), open_.alias("open"), done.alias("done"))

        return F.when(~enters & (place < first), now).otherwise(_let(now["counts"][code - 1], moved))

    steps = F.sequence(F.lit(0), (last - first) * 2 + 1)
    return F.aggregate(steps, state, step, lambda end: F.when(end["open"].isNull(), end["done"]).otherwise(F.concat(end["done"], F.array(end["open"]))))


def _joined(spans: Column) -> Column:
    """Spans in order, those that meet made one."""
    begins = lambda every: F.filter(every, lambda x, i: (i == 0) | (x["start"] > every[F.greatest(i - 1, F.lit(0))]["end"]))
    ends = lambda every: F.filter(every, lambda x, i: (i == F.size(every) - 1) | (every[F.least(i + 1, F.size(every) - 1)]["start"] > x["end"]))
    return _let(spans, lambda every: F.zip_with(begins(every), ends(every), lambda a, b: F.struct(a["start"].alias("start"), b["end"].alias("end"))))


def entropy_spans(text: Column, sign: str, symbols: str, bits: float, allowed: tuple[str, ...] = ALLOWED) -> Column:
    """array<struct<start, end>> of the joined windows of runs of ``sign`` whose entropy is at least ``bits``."""
    most = math.floor(SCALE * WINDOW * (math.log2(WINDOW) - bits))
    fold = symbols.lower() == symbols

    def scan(run: Column) -> Column:
        codes = F.transform(F.slice(F.split(run["found"], ""), 1, F.length(run["found"])), lambda c: F.instr(F.lit(symbols), F.lower(c) if fold else c))
        blocks = lambda own: F.flatten(F.transform(F.sequence(F.lit(0), F.size(own) - WINDOW, F.lit(BLOCK)), lambda b: _slide(own, b, len(symbols), most)))
        spans = _joined(_let(codes, blocks))
        string = lambda s: F.substring(run["found"], s["start"] + 1, s["end"] - s["start"])
        suppressed = lambda s: F.lit(False) if not allowed else F.array_max(F.array(*[string(s).rlike(p) for p in allowed]))
        return F.transform(F.filter(spans, lambda s: ~suppressed(s)), lambda s: F.struct((run["start"] + s["start"]).alias("start"), (run["start"] + s["end"]).alias("end")))

    return F.flatten(F.transform(matches(text, f"{sign}{{{WINDOW},}}"), scan))


def scan(docs: DataFrame, text: str = "text", allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """The columns of ``docs`` and base_spans, all_spans: array<struct<start, kind (place in KINDS, then CLASSES), end>>."""
    whole = F.coalesce(F.col(text), F.lit(""))
    found = docs.withColumn("base_spans", base_spans(whole))
    more = [_shaped(k, entropy_spans(whole, sign, symbols, bits, allowed)) for k, (_, sign, symbols, bits) in enumerate(CLASSES, len(KINDS))]
    new = F.filter(F.concat(*more), lambda s: ~F.exists("base_spans", lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])))
    return found.withColumn("all_spans", F.array_sort(F.concat("base_spans", new)))


def _text(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, *[c[0] for c in CLASSES])])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    many = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return scan(docs.select("doc_id", "text")).select("doc_id", *[many(k).alias(f"n_{name}") for k, name in enumerate(KINDS)], F.sha2(_text("base_spans").cast("binary"), 256).alias("base_sha256"), _text("all_spans").alias("spans"))


def _oracle() -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    base = (ASSIGN, "AKIA[A-Z0-9]+", "[0-9a-f]+")
    kinds = [(k, p, 1 if k == 0 else 0) for k, p in enumerate((*base, *[f"{sign}{{{WINDOW},}}" for _, sign, _, _ in CLASSES]))]
    found = " UNION ALL ".join(f"SELECT r, {k} AS kind, string_split_regex(x, {quoted(p)}) AS g, regexp_extract_all(x, {quoted(p)}, 0) AS m, regexp_extract_all(x, {quoted(p)}, {v}) AS v FROM t WHERE regexp_matches(x, {quoted(p)})" for k, p, v in kinds)
    most = " ".join(f"WHEN {len(KINDS) + k} THEN {math.floor(SCALE * WINDOW * (math.log2(WINDOW) - bits))}" for k, (_, _, _, bits) in enumerate(CLASSES))
    names = " ".join(f"WHEN {k} THEN '{name}'" for k, name in enumerate((*KINDS, *[c[0] for c in CLASSES])))
    allowed = " OR ".join(f"regexp_matches(substr(m, s + 1, e - s), {quoted(p)})" for p in ALLOWED)
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
f AS ({found}),
u AS (SELECT r, kind, unnest(g[:len(m)]) AS g, unnest(m) AS m, unnest(v) AS v, unnest(range(len(m))) AS i FROM f),
p AS (SELECT r, kind, m, v, sum(length(g) + length(m)) OVER (PARTITION BY r, kind ORDER BY i) AS e FROM u),
b AS (SELECT r, kind, e - length(m) AS s, e FROM p WHERE (kind = 0 AND length(v) >= 12) OR (kind = 1 AND length(m) >= 18) OR (kind = 2 AND length(m) >= 16)),
w AS (SELECT r, kind, m, e - length(m) AS o, unnest(range(length(m) - {WINDOW} + 1)) AS w FROM p WHERE kind > 2),
h AS (SELECT * FROM w WHERE list_sum(list_transform(map_values(list_aggregate(string_split(CASE kind WHEN 3 THEN lower(substr(m, w + 1, {WINDOW})) ELSE substr(m, w + 1, {WINDOW}) END, ''), 'histogram')), lambda c: round(c * log2(c) * {SCALE}))) <= CASE kind {most} END),
j AS (SELECT *, sum(CASE WHEN before IS NULL OR w > before + {WINDOW} THEN 1 ELSE 0 END) OVER (PARTITION BY r, kind, o ORDER BY w) AS island FROM (SELECT *, lag(w) OVER (PARTITION BY r, kind, o ORDER BY w) AS before FROM h)),
k AS (SELECT r, kind, o, any_value(m) AS m, min(w) AS s, max(w) + {WINDOW} AS e FROM j GROUP BY r, kind, o, island),
n AS (SELECT r, kind, o + s AS s, o + e AS e FROM k WHERE NOT ({allowed})),
a AS (SELECT * FROM b UNION ALL SELECT n.* FROM n WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.r = n.r AND b.s <= n.s AND n.e <= b.e)),
l AS (SELECT r, kind, s, (CASE kind {names} END) || ':' || s::BIGINT || ':' || e::BIGINT AS z FROM a),
o AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, string_agg(z, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg(z, ',' ORDER BY s, kind) AS spans FROM l GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN o USING (r)
"""


#: The base rules as they are stated, windows one by one: the same rows by other means.
ORACLE = _oracle()
