"""URL filter: host and path rules first, then a weighted vocabulary.

A rule (host, path prefix) fits its host and all subdomains; the longest
fitting rule decides.  Where none fits, an Aho-Corasick automaton finds the
vocabulary's strict and soft terms in the lower-cased URL; a term counts only
between boundaries (no ASCII letter or digit on either side), and one strict
term or ``soft_limit`` distinct soft terms block the URL.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

#: Fixed values: (host, path, verdict) of the registered query's rules.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"),
         ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Terms that block on their own, and terms of which several distinct ones do.
STRICT = ("casino", "porn", "xxx", "adult", "poker", "viagra", "gambling", "escort")
SOFT = ("ads", "track", "win", "bet", "free", "bonus", "click", "promo", "cheap", "deal",
        "sex", "x", "popup", "banner")

_PARTS = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_UPPER_TO_LOWER = {c: c + 32 for c in range(65, 91)}


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host after the first ``://``, A-Z lower-cased, and the path up to ? or #;
    both empty for a null URL or one without ``://``."""
    found = _PARTS.search(url) if url else None
    return (found[1].translate(_UPPER_TO_LOWER), found[2]) if found else ("", "")


class UrlRules:
    """Rules by host; a host is looked up by its own name and each parent's."""

    def __init__(self, rules):
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for host, path, verdict in rules:
            self.by_host.setdefault(host, []).append((path, verdict))
        for entries in self.by_host.values():
            entries.sort(key=lambda e: (-len(e[0]), e[1]))

    def longest(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule string, verdict) of the longest rule that fits."""
        best = None
        while host:
            for prefix, verdict in self.by_host.get(host, ()):
                if path.startswith(prefix):
                    if best is None or len(host) + len(prefix) > len(best[0]):
                        best = (host + prefix, verdict)
                    break
            host = host.partition(".")[2]
        return best


class Vocabulary:
    """Aho-Corasick automaton over strict and soft terms."""

    def __init__(self, strict, soft):
        self.machine = ahocorasick.Automaton()
        for term in soft:
            self.machine.add_word(term, (term, False))
        for term in strict:
            self.machine.add_word(term, (term, True))
        self.machine.make_automaton()

    def hits(self, url: str) -> tuple[set[str], set[str]]:
        """Distinct strict and soft terms that stand between boundaries."""
        text = url.translate(_UPPER_TO_LOWER)
        strict, soft = set(), set()
        if not len(self.machine):
            return strict, soft
        for last, (term, is_strict) in self.machine.iter(text):
            before, after = last - len(term), last + 1
            if (before >= 0 and _inside(text[before])) or (
                    after < len(text) and _inside(text[after])):
                continue
            (strict if is_strict else soft).add(term)
        return strict, soft


def _inside(c: str) -> bool:
    return c.isascii() and c.isalnum()


def _judged(batches: Iterator[pa.RecordBatch], rules, strict, soft, soft_limit: int):
    known, words = UrlRules(rules), Vocabulary(strict, soft)
    for batch in slices(batches, 4096):
        rows = []
        for url in batch.column("url").to_pylist():
            host, path = host_and_path(url)
            rule = known.longest(host, path)
            hard, mild = words.hits(url or "")
            verdict = rule[1] if rule else (
                "block" if hard or len(mild) >= soft_limit else "allow")
            rows.append((host, path, rule and rule[0], verdict, len(hard), len(mild)))
        cols = list(zip(*rows)) if rows else [()] * 6
        kinds = [pa.string()] * 4 + [pa.int32()] * 2
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
            names=["page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft"])


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES,
               strict=STRICT, soft=SOFT, soft_limit: int = 2) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, n_strict, n_soft.

    A null URL, or one without ``://``, has an empty host and path; no rule fits
    it and the vocabulary decides (null: allow).  Of rules of one host and path
    allow goes before block.  Repeated rows give repeated results, an empty
    table none.  Rules and terms are the caller's parameters and travel with
    the tasks.  Reads two columns and shuffles nothing.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    return pages.selectExpr(f"`{id_col}` AS page_id", f"`{url_col}` AS url").mapInArrow(
        lambda batches: _judged(batches, rules, strict, soft, soft_limit),
        f"page_id {kind}, host string, path string, rule string, verdict string, "
        "n_strict int, n_soft int")


def _allowed(batches: Iterator[pa.RecordBatch], url_col: str, rules, strict, soft,
             soft_limit: int):
    for batch in batches:
        asked = pa.RecordBatch.from_arrays(
            [pa.array(range(batch.num_rows), pa.int64()), batch.column(url_col)],
            names=["page_id", "url"])
        kept = [at for judged in _judged(iter([asked]), rules, strict, soft, soft_limit)
                for at, verdict in zip(judged.column("page_id").to_pylist(),
                                       judged.column("verdict").to_pylist())
                if verdict == "allow"]
        yield batch.take(pa.array(kept, pa.int64()))


def keep_allowed(pages: DataFrame, url_col: str = "url", rules=RULES, strict=STRICT, soft=SOFT,
                 soft_limit: int = 2) -> DataFrame:
    """The rows whose URL is allowed, with all their columns and no others.

    Every row is judged by its own URL where it is read, so rows that share an
    id, or have none, are decided apart; a null URL is allowed; an empty table
    gives no rows."""
    return pages.mapInArrow(lambda batches: _allowed(batches, url_col, rules, strict, soft,
                                                     soft_limit), pages.schema)
