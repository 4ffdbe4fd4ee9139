"""Text of chunks and tokens of texts, as columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pieces of a part between underscores: each starts at an upper-case letter, the first anywhere.
_CASED = r"(^[^\p{Lu}]+|\p{Lu}[^\p{Lu}]*)"


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def _plain(raw: Column) -> Column:
    return (F.lower(raw) == raw) & ~F.contains(raw, F.lit("_"))


def _parts_of(raw: Column) -> Column:
    def again(parts: Column) -> Column:
        before = lambda i: F.when(i == 0, F.lower(raw)).otherwise(F.lower(F.get(parts, i - 1)))
        return F.filter(F.transform(parts, lambda p, i: F.when(p != before(i), F.lower(p))), lambda p: p.isNotNull())

    return _let(F.filter(F.split(raw, "_"), lambda p: p != ""), again)


def _pieces_of(part: Column) -> Column:
    return _let(F.regexp_extract_all(part, F.lit(_CASED), F.lit(1)), lambda found: F.when(F.size(found) > 1, F.transform(found, lambda p: F.lower(p))).otherwise(F.array().cast("array<string>")))


def _all_of(raw: Column) -> Column:
    # most runs are one part in lower case: they skip the rest
    return F.when(_plain(raw), F.array(raw)).otherwise(F.concat(F.array(F.lower(raw)), _parts_of(raw), F.flatten(F.transform(F.split(raw, "_"), _pieces_of))))


def tokenize(text: Column) -> Column:
    """array<string> of the tokens of a text; repetitions count.

    A run of letters, digits and underscores, without those at its ends, is a token in lower
    case.  So is each part between underscores that differs from the token before it, where
    the part keeps its case for the comparison: a part with an upper-case letter is said
    again.  Last come a part's pieces by upper-case letters, if there are several.  Null has
    no tokens.
    """
    runs = F.transform(_runs(text), lambda r: F.btrim(r, F.lit("_")))
    return F.coalesce(F.flatten(F.transform(F.filter(runs, lambda r: r != ""), _all_of)), F.array().cast("array<string>"))


def bag(text: Column) -> Column:
    """The tokens of tokenize() in no order, in less time: runs that are one part in lower case are taken as they are."""

    def body(runs: Column) -> Column:
        odd = F.filter(F.transform(F.filter(runs, lambda r: ~_plain(r)), lambda r: F.btrim(r, F.lit("_"))), lambda r: r != "")
        return F.concat(F.filter(runs, _plain), F.flatten(F.transform(odd, _all_of)))

    return F.coalesce(_let(_runs(text), body), F.array().cast("array<string>"))


def runs(text: Column) -> Column:
    """The runs of letters, digits and underscores that tokenize() reads, as they stand."""
    return F.coalesce(_runs(text), F.array().cast("array<string>"))


def run_tokens(run: str) -> list[str]:
    """The tokens of tokenize() of one run, for tasks that look at each different run once."""
    run = run if "_" not in run else run.strip("_")
    whole = run.lower()
    if not run or whole == run and "_" not in run:
        return [run] if run else []
    out, before = [whole], whole
    for part in filter(None, run.split("_")):
        if part != before:
            out.append(part.lower())
        before = part.lower()
    for part in run.split("_"):
        starts = [i for i, c in enumerate(part) if not i or unicodedata.category(c) == "Lu"]
        if len(starts) > 1:
            out += [part[a:z].lower() for a, z in zip(starts, [*starts[1:], None])]
    return out


def searchable_text(c=F.col) -> Column:
    """What is indexed of a chunk: labelled lines; those of the docstring, imports and calls only where there are any."""
    line = lambda label, value: F.when(value != "", F.concat(F.lit(f"{label}: "), value))
    always = [F.concat(F.lit(f"{label}: "), c(name)) for label, name in (("FILE", "file_path"), ("LANGUAGE", "language"), ("TYPE", "symbol_type"), ("SYMBOL", "symbol_name"))]
    lists = [line(label, F.array_join(c(name), ", ")) for label, name in (("IMPORTS", "imports"), ("CALLS", "calls"))]
    return F.concat_ws("\n", *always, line("DOCSTRING", c("docstring")), *lists, F.lit("CODE:"), c("code"))


def metadata_text(c=F.col) -> Column:
    """What the reranker reads of a chunk besides its code."""
    single = [F.coalesce(c(n), F.lit("")) for n in ("file_path", "language", "symbol_name", "symbol_type", "docstring", "class_name", "parent_symbol")]
    return F.rtrim(F.concat_ws(" ", *single, c("imports"), c("calls")))


#: Names of languages in queries, and what they stand for; longer ones go first.
QUERY_LANGUAGES = {"javascript": "JavaScript", "typescript": "TypeScript", "python": "Python", "java": "Java", "c++": "C++"}


def query_language(query: Column) -> Column:
    """The language that a query names as a word of its own, or null."""
    found = [F.when(F.lower(query).rlike(rf"(^|[^a-z0-9])\Q{name}\E([^a-z0-9]|$)"), F.lit(language)) for name, language in QUERY_LANGUAGES.items()]
    return F.coalesce(*found)


def names_identifier(query: Column, symbol: Column) -> Column:
    """Does the query say the symbol, or what follows its last dot, as a word of its own?"""
    last = F.substring_index(symbol, ".", -1)
    bounded = lambda name: F.rlike(F.lower(query), F.concat(F.lit(r"(?<![a-z0-9_])\Q"), F.lower(name), F.lit(r"\E(?![a-z0-9_])")))
    return F.when(symbol == "", False).otherwise(bounded(symbol) | ((last != "") & bounded(last)))


def stable_id(*parts: Column, length: int = 20) -> Column:
    """The first hex digits of the SHA-1 of the parts joined by colons."""
    return F.substring(F.sha1(F.concat_ws(":", *parts)), 1, length)


def extension(file_path: Column) -> Column:
    """The file's extension in lower case, with its dot."""
    return F.lower(F.regexp_extract(file_path, r"(\.[^./]*)$", 1))
