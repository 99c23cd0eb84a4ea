"""Secret scan: known forms, and stretches of high entropy inside strings of a character class.

Known forms (assignments, access keys, hexadecimal digits) are regular expressions.  The
entropy method looks at candidate strings: runs of a class of characters that are at
least a window long.  A window slides over a candidate; the counts of its characters are
kept up to date by one character that enters and one that leaves, and so is the sum of
n log n over the counts, which is the window's Shannon entropy but for constants.  Windows
of enough entropy that overlap are one span.  Candidates that an allow-list knows (words
joined by signs, placeholders, alphabets, identifiers, digests named as such) are left out.

Everything is an expression over one row: nothing is shuffled, a long text costs in
proportion to its length, and sums are whole numbers, so that no order of summing matters.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphrake.functions.matching import let, regex_matches
from glyphrake.llm.common import table

#: The known forms, in the order in which spans that begin together are listed: fixed values.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
LEAST_ASSIGNED = 12
#: Runs of at least the wanted length are what is left of all runs once shorter ones are dropped.
ACCESS, LEAST_HEX = "AKIA[A-Z0-9]{14,}", 16


def whole_runs(characters: str, least: int) -> str:
    """Runs of a set of characters, tried only where one begins and not again at each of its characters."""
    return f"(?<![{characters}])[{characters}]{{{least},}}"


#: Sums of n log2 n are whole numbers of this part.
PARTS = 1 << 20


@dataclass(frozen=True)
class CharacterClass:
    """Runs of alphabet (a regular expression's set) of window characters or more; entropy in bits that a window needs at least."""

    name: str
    characters: str
    alphabet: str
    window: int
    entropy: float
    folded: bool = False

    @property
    def grown(self) -> list[int]:
        """n log2 n for n up to the window, in parts."""
        return [0, *(round(n * math.log2(n) * PARTS) for n in range(1, self.window + 1))]

    @property
    def limit(self) -> int:
        """The sum of n log n, in parts, that a window of just enough entropy has."""
        return math.floor((math.log2(self.window) - self.entropy) * self.window * PARTS)


#: Digits in either case count as the same.  Random windows have 3.4 and 4.35 bits on average, concatenated words 3.3 at most.
CLASSES = (CharacterClass("entropy_hex", "0-9A-Fa-f", "0123456789abcdef", 20, 3.0, True), CharacterClass("entropy_base64", "A-Za-z0-9+/_-", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 24, 4.05))
KINDS = ("assign", "access", "hex", *(c.name for c in CLASSES))
#: Candidates that are no secrets, whole: words joined by signs, placeholders, alphabets, identifiers with their dashes.
ALLOWED = (r"^[/_+-]*[A-Z]?[a-z]*([/_+-]+[A-Z]?[a-z]*)*$", r"(?i)example|sample|placeholder|changeme|redacted|your[_-]|xxxx", r"(?i)abcdefgh|0123456789|ghijklmn", r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$")
#: Endings of what stands right before a candidate that say so, and how many characters of it are looked at.
ALLOWED_AFTER, BEFORE = (r"(?i)(sha-?[0-9]{0,3}|md5|integrity|etag|checksum|commit|revision)[\x20:=\"'-]*$",), 24

SPANS = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def window_spans(run: Column, own: CharacterClass) -> Column:
    """ARRAY of start, end in the run: windows of at least the class's entropy, overlapping ones together.

    The state of the fold is the counts of the window, their sum of n log n, the span that
    is open and those that are closed.
    """
    size, grown = own.window, F.array(*map(F.lit, own.grown))

    def slid(codes: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            enters = F.element_at(codes, i + 1)
            leaves = F.when(i >= size, F.element_at(codes, F.greatest(i - size, F.lit(0)) + 1)).otherwise(F.lit(-1))
            counts, level = state["counts"], lambda code, more: F.element_at(grown, F.element_at(counts, code + 1) + 1 + more)
            counted = F.transform(counts, lambda n, k: n + (k == enters).cast("int") - (k == leaves).cast("int"))
            gained = level(enters, 1) - level(enters, 0)
            lost = F.when(leaves >= 0, level(F.greatest(leaves, F.lit(0)), -1) - level(F.greatest(leaves, F.lit(0)), 0)).otherwise(F.lit(0))
            same = enters == leaves
            total = state["total"] + F.when(same, F.lit(0)).otherwise(gained + lost)
            hit, first = (i >= size - 1) & (total <= own.limit), i - size + 1
            joins = state["end"] >= first
            closed = F.when(hit & ~joins & (state["end"] > 0), F.concat(state["closed"], F.array(F.struct(state["begin"].alias("start"), state["end"].alias("end"))))).otherwise(state["closed"])
            begin = F.when(hit & ~(joins & (state["end"] > 0)), first).otherwise(state["begin"])
            end = F.when(hit, i + 1).otherwise(state["end"])
            return F.struct(F.when(same, counts).otherwise(counted).alias("counts"), total.cast("long").alias("total"), begin.cast("int").alias("begin"), end.cast("int").alias("end"), closed.alias("closed"))

        none = F.array().cast("array<struct<start:int,end:int>>")
        zero = F.struct(F.array_repeat(F.lit(0), len(own.alphabet)).alias("counts"), F.lit(0).cast("long").alias("total"), F.lit(0).alias("begin"), F.lit(0).alias("end"), none.alias("closed"))
        last = lambda s: F.when(s["end"] > 0, F.concat(s["closed"], F.array(F.struct(s["begin"].alias("start"), s["end"].alias("end"))))).otherwise(s["closed"])
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), zero, step, last)

    letters = F.split(F.lower(run) if own.folded else run, "")
    return let(F.transform(letters, lambda c: F.instr(F.lit(own.alphabet), c) - 1), slid)


def _allowed(text: Column, m: Column) -> Column:
    known = F.lit(False)
    for pattern in ALLOWED:
        known = known | m["found"].rlike(pattern)
    before = F.substring(text, F.greatest(m["start"] - BEFORE, F.lit(0)).cast("int") + 1, F.least(m["start"], F.lit(BEFORE)).cast("int"))
    for pattern in ALLOWED_AFTER:
        known = known | before.rlike(pattern)
    return known


def entropy_spans(text: Column, own: CharacterClass) -> Column:
    """SPANS of one class in a text."""
    found = let(regex_matches(text, whole_runs(own.characters, own.window)), lambda runs: F.filter(runs, lambda m: ~_allowed(text, m)))
    inside = lambda m: F.transform(window_spans(m["found"], own), lambda w: F.struct((m["start"] + w["start"]).alias("start"), (m["start"] + w["end"]).alias("end")))
    return _spans(F.flatten(F.transform(found, inside)), own.name)


def known_spans(text: Column) -> Column:
    """SPANS of the known forms.

    Matches of a form are leftmost and do not overlap; those that are too short are
    dropped afterwards, so that what they cover is not looked at again.
    """
    assigned = F.filter(regex_matches(text, ASSIGN, 2), lambda m: F.char_length(m["g2"]) >= LEAST_ASSIGNED)
    return F.concat(_spans(assigned, "assign"), _spans(regex_matches(text, ACCESS), "access"), _spans(regex_matches(text, whole_runs("0-9a-f", LEAST_HEX)), "hex"))


def find_secrets(docs: DataFrame, classes: Sequence[CharacterClass] = CLASSES) -> DataFrame:
    """docs' rows as doc_id, spans: ARRAY of start, rank, kind, end, by start and then by kind.

    Places count code points from 0, ends are exclusive, and an assignment's span is the
    whole of it, name and quotes included.  Null and empty texts have no spans; repeated
    rows and ids stay rows of their own; other columns are not read; an empty table gives
    no rows.
    """
    text = F.coalesce("text", F.lit(""))
    every = docs.select("doc_id", F.concat(known_spans(text), *(entropy_spans(text, c) for c in classes)).alias("spans"))
    return every.select("doc_id", F.array_sort("spans").cast(SPANS).alias("spans"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _counted(rank: int) -> Column:
    return F.size(F.filter("spans", lambda x: x["rank"] == rank)).cast("long")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents: counts and digest of the known forms, and all spans; see find_secrets()."""
    found = find_secrets(table(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.filter("spans", lambda x: x["rank"] < 3)
    counts = (_counted(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3]))
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def _sql() -> str:
    """The same in DuckDB: every window by itself, its characters counted anew."""

    def quoted(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    def matches(name: str, pattern: str, group: int = 0) -> str:
        p = quoted(pattern)
        return f"{name}_rows AS (SELECT row, text, regexp_extract_all(text, {p}) AS found, regexp_extract_all(text, {p}, {group}) AS own, list_transform(regexp_split_to_array(text, {p}), lambda x: length(x)) AS between FROM d WHERE regexp_matches(text, {p})), {name} AS (SELECT row, text, found[i] AS found, own[i] AS own, (list_sum(between[:i]) + coalesce(list_sum(list_transform(found[:i - 1], lambda x: length(x))), 0))::BIGINT AS start FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM {name}_rows))"

    parts = [f"d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents), {matches('assign', ASSIGN, 2)}, {matches('access', ACCESS)}, {matches('hexa', f"[0-9a-f]{{{LEAST_HEX},}}")}"]
    spans = [f"SELECT row, {i} AS rank, '{kind}' AS kind, start, start + length(found) AS stop FROM {name}{where}" for i, (kind, name, where) in enumerate((("assign", "assign", f" WHERE length(own) >= {LEAST_ASSIGNED}"), ("access", "access", ""), ("hex", "hexa", "")))]
    for rank, c in enumerate(CLASSES, 3):
        allowed = " OR ".join([f"regexp_matches(found, {quoted(p)})" for p in ALLOWED] + [f"regexp_matches(substr(text, greatest(start - {BEFORE}, 0) + 1, least(start, {BEFORE})), {quoted(p)})" for p in ALLOWED_AFTER])
        run, letters = ("lower(found)" if c.folded else "found"), "[" + ", ".join(f"'{x}'" for x in c.alphabet) + "]"
        total = f"list_sum(list_transform({letters}, lambda a: {c.grown}[{c.window} - length(replace(w, a, '')) + 1]))"
        parts.append(f"""{matches(f'r{rank}', f"[{c.characters}]{{{c.window},}}")},
w{rank} AS (SELECT row, start, i, substr({run}, (i + 1)::BIGINT, {c.window}) AS w FROM (SELECT *, unnest(range(0, length(found) - {c.window} + 1)) AS i FROM r{rank} WHERE NOT ({allowed}))),
h{rank} AS (SELECT row, start, i, CASE WHEN i - lag(i) OVER (PARTITION BY row, start ORDER BY i) <= {c.window} THEN 0 ELSE 1 END AS opens FROM w{rank} WHERE {total} <= {c.limit}),
s{rank} AS (SELECT row, start, i, sum(opens) OVER (PARTITION BY row, start ORDER BY i) AS nth FROM h{rank})""")
        spans.append(f"SELECT row, {rank}, '{c.name}', start + min(i), start + max(i) + {c.window} FROM s{rank} GROUP BY row, start, nth")
    listed = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank){}, '')"
    return f"""WITH {', '.join(parts)}, spans AS ({' UNION ALL '.join(spans)})
SELECT any_value(doc_id) AS doc_id, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in KINDS[:3])}, sha256({listed.format(' FILTER (rank < 3)')}) AS base_sha256, {listed.format('')} AS spans FROM d LEFT JOIN spans USING (row) GROUP BY row"""


ORACLE_SQL = _sql()
