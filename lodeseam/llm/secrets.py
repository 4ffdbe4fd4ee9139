"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings.  DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # AKIA[A-Z0-9]+ of 20 or more: a run that is too short has no later start that is long enough
HEX = r"[0-9a-f]{24,}"  # [0-9a-f]+ of 24 or more: matches are whole runs either way
_RUN = "A-Za-z0-9+/_=-"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


@dataclass(frozen=True)
class EntropyRule:
    """Windows of ``window`` characters of a run reach ``hexadecimal``, ``one_case`` or ``mixed`` bits by its character class."""

    window: int = 20
    hexadecimal: float = 3.0
    one_case: float = 3.6
    mixed: float = 3.8
    #: What matches is part of no secret: documentation examples, alphabets, repeated marks.  The rest of its run is judged by itself.
    allow: tuple[str, ...] = (r"(?i:example|sample|placeholder|changeme)", r"(?i:abcdefgh|12345678)", r"[-=_+/]{8}")

    @property
    def candidates(self) -> str:
        """Whole runs of at least a window with a letter and a digit; both scans of a run start at its beginning only."""
        return f"(?<![{_RUN}])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[{_RUN}]{{{self.window},}}"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a lambda variable, where a column would be computed at each mention."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Numbers that one block sums; blocks of blocks sum theirs.
_BLOCK = 64


def _sums_before(numbers: Column, depth: int = 3) -> Column:
    """For each of ``numbers``, the sum of those before it.

    An array that grows by one is copied each time, so it grows within blocks only: ``depth``
    levels of them keep the work in proportion to the numbers up to 64 ** (depth + 1).
    """
    if not depth:
        more = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(numbers, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), more, lambda acc: acc["out"])

    def over(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda a, n: a + n))
        inside = F.transform(blocks, lambda block: _sums_before(block, 0))
        return F.flatten(F.zip_with(inside, _let(totals, lambda t: _sums_before(t, depth - 1)), lambda places, at: F.transform(places, lambda x: x + at)))

    starts = F.when(F.size(numbers) > 0, F.sequence(F.lit(1), F.size(numbers), F.lit(_BLOCK))).otherwise(F.array().cast("array<int>"))
    return _let(F.transform(starts, lambda i: F.slice(numbers, i, _BLOCK)), over)


def _located(text: Column, pattern: str, make) -> Column:
    """array<struct<start, last, keep>> of the pattern's matches: each match's place is the sum of what lies before it."""
    none = F.array().cast("array<struct<start:int,last:int,keep:boolean>>")

    def place(found: Column, gaps: Column, keep: Column) -> Column:
        sizes = F.transform(found, lambda m: F.length(m))
        before = _let(F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), sizes, lambda g, n: g + n), lambda n: _sums_before(n))
        # a match starts where those before it, with the gaps before them, and its own gap end
        starts = F.zip_with(before, F.slice(gaps, F.lit(1), F.size(found)), lambda at, g: at + g)
        spans = F.zip_with(starts, sizes, lambda at, n: F.struct(at.alias("start"), (at + n).alias("last")))
        return F.zip_with(spans, keep, lambda s, k: F.struct(s["start"].alias("start"), s["last"].alias("last"), k.alias("keep")))

    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    placed = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: _let(gaps, lambda g: _let(make(found), lambda keep: place(found, g, keep))))
    return F.when(text.rlike(pattern), placed).otherwise(none)


def _always(found: Column) -> Column:
    return F.transform(found, lambda m: F.lit(True))


def window_entropy(candidate: Column, window: int) -> Column:
    """The largest Shannon entropy, in bits, of any ``window`` characters in a row, from counts that each step changes by two."""
    weight = lambda c: F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(0.0)
    change = lambda before, after: weight(after) - weight(before)

    def walk(places: Column) -> Column:
        def step(acc, i):
            ends = F.struct(F.get(places, i - 1).alias("enter"), F.when(i > window, F.get(places, i - window - 1)).otherwise(-1).alias("leave"))

            def move(e):
                entering, leaving = F.get(acc["counts"], e["enter"]), F.coalesce(F.get(acc["counts"], e["leave"]), F.lit(0))
                moved = change(entering, entering + 1) + F.when(e["leave"] >= 0, change(leaving, leaving - 1)).otherwise(0.0)
                total = acc["total"] + F.when(e["enter"] == e["leave"], 0.0).otherwise(moved)
                counts = F.transform(acc["counts"], lambda c, k: c + (k == e["enter"]).cast("int") - (k == e["leave"]).cast("int"))
                bits = F.log2(F.lit(float(window))) - total / window
                best = F.when(i >= window, F.greatest(acc["best"], bits)).otherwise(acc["best"])
                return F.struct(counts.alias("counts"), total.alias("total"), best.alias("best"))

            return _let(ends, move)

        start = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"))
        return F.aggregate(F.sequence(F.lit(1), F.size(places)), start, step, lambda acc: acc["best"])

    letters = F.regexp_extract_all(candidate, F.lit("(?s)."), F.lit(0))
    return F.when(F.length(candidate) >= window, _let(F.transform(letters, lambda ch: F.instr(F.lit(ALPHABET), ch) - 1), walk)).otherwise(0.0)


def _random_looking(rule: EntropyRule):
    def judge(part: Column) -> Column:
        least = F.when(part.rlike("^[0-9a-fA-F]+$"), rule.hexadecimal).when(part.rlike("[a-z]") & part.rlike("[A-Z]"), rule.mixed).otherwise(rule.one_case)
        return part.rlike("[0-9]") & part.rlike("[A-Za-z]") & (window_entropy(part, rule.window) >= least)

    def keep(found: Column) -> Column:
        # windows that touch what the allow-list matches are not measured; those on either side are
        parts = (lambda m: F.split(m, "|".join(f"(?:{a})" for a in rule.allow), -1)) if rule.allow else F.array
        return F.transform(found, lambda m: F.exists(parts(m), judge))

    return keep


def scan(docs: DataFrame, rule: EntropyRule = EntropyRule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) of every row: array<struct<start, kind, last>> by start, then kind, in code points, last exclusive.

    Kinds are 0 assign, 1 access, 2 hex (fixed patterns over the whole text, leftmost and not
    overlapping) and 3 entropy: whole runs of letters, digits and ``+/_=-`` with a window that
    looks random and does not touch what the allow-list matches.  The allow-list touches only
    the last kind.  A null or empty text has no
    spans; repeated rows and rows without a doc_id are scanned alike; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    long_value = lambda found: F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= 6)
    kinds = ((ASSIGN, long_value), (ACCESS, _always), (HEX, _always), (rule.candidates, _random_looking(rule)))

    def of_kind(k: int, pattern: str, make) -> Column:
        kept = F.filter(_located(text, pattern, make), lambda s: s["keep"])
        return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["last"].alias("last")))

    parts = [of_kind(k, *kind) for k, kind in enumerate(kinds)]
    return docs.select(F.col(id_col).alias("doc_id"), F.array_sort(F.concat(*parts)).alias("spans"))


KINDS = ("assign", "access", "hex", "entropy")


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    """The contract's counts and digests of scan() over all documents."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    said = lambda s: F.concat(F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["last"].cast("string"))
    joined = lambda spans: F.array_join(F.transform(spans, said), ",")
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(joined(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), of(3).alias("n_entropy")
    )
