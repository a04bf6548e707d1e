"""URL filter: pattern rules indexed by their rarest literal token.

A rule is ``(verdict, pattern)``; a pattern is ``host/path`` where ``*``
stands for any run of characters.  It fits a url when the url's host is the
rule's host or one of its subdomains and the url's path starts with the
rule's path.  Of the fitting rules the longest pattern wins; between equal
lengths the smaller text, then ``block``.

How it runs on Spark:

1. one job counts, over every url, the tokens that occur in a rule (partial
   sums before the shuffle; at most one row for each rule token comes back);
2. each rule is filed under its rarest literal token;
3. a url's tokens fetch the rules filed under them, and only those run their
   regular expression, inside ``mapInArrow`` without any shuffle.

The rule list is a parameter of the job (bounded by ``MAX_RULES``), so the
index that travels with the tasks is bounded too.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripple.llm.common import slices

MAX_RULES = 100_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TOKEN = r"[A-Za-z0-9_-]+"


def host_of(url):
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, UPPER.lower())


def path_of(url):
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def pattern_regex(pattern: str) -> str:
    """The regular expression of a rule, to be matched against host + path."""
    return r"(?s)\A(?:[^/]*\.)?" + ".*".join(re.escape(x) for x in pattern.split("*"))


def whole_tokens(pattern: str) -> list[str]:
    """Literal tokens that every fitting url must contain as whole tokens.

    A token that touches a ``*`` or an open end may continue in the url, so
    it is left out; the first one is whole because hosts fit on a dot.
    """
    out = []
    for m in re.finditer(TOKEN, pattern):
        closed = m.end() < len(pattern) and pattern[m.end()] != "*"
        if closed and (m.start() == 0 or pattern[m.start() - 1] != "*"):
            out.append(m.group())
    return out


def token_counts(urls: DataFrame, rules: list[tuple[str, str]]) -> dict[str, int]:
    """In how many urls each rule token occurs: one row for each rule token at most."""
    wanted = sorted({t for _, p in rules for t in whole_tokens(p)})
    if not wanted:
        return {}
    # the separator cannot be part of a token
    tokens = F.regexp_extract_all(F.concat_ws("/", "host", "path"), F.lit(f"({TOKEN})"), 1)
    counted = (urls.select(F.explode(F.array_distinct(tokens)).alias("token"))
               .where(F.col("token").isin(wanted)).groupBy("token").count())
    return {r["token"]: r["count"] for r in counted.collect()}


def rule_index(rules: list[tuple[str, str]], counts: dict[str, int]) -> dict[str | None, list]:
    """token -> rules filed there; ``None`` holds the rules without a literal token."""
    index: dict[str | None, list] = {}
    for verdict, pattern in rules:
        token = min(whole_tokens(pattern), key=lambda t: (counts.get(t, 0), t), default=None)
        index.setdefault(token, []).append((pattern, verdict, pattern_regex(pattern)))
    return index


def judge(urls: DataFrame, rules: Iterable[tuple[str, str]], id_col: str = "page_id", url_col: str = "url",
          default: str = "allow") -> DataFrame:
    """Judge every row of ``urls``; returns id, host, path, rule and verdict, one row for each input row.

    A null url or one without ``://`` has an empty host and path and gets
    ``default`` unless a rule fits the empty text; so does an empty table's
    absent row.  Repeated rows are judged alike.  Null ids are kept.  Other
    columns of the input, whatever their names, are left out.
    """
    rules = list(dict.fromkeys((v, p) for v, p in rules))
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules: the index that travels with the tasks holds {MAX_RULES}")
    for verdict, _ in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"verdict {verdict!r}")
    kind = dict(urls.dtypes)[id_col]
    parsed = urls.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"),
                         path_of(F.col(url_col)).alias("path"))
    index = rule_index(rules, token_counts(parsed, rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = {t: [(p, v, re.compile(x)) for p, v, x in found] for t, found in index.items()}
        always, token = compiled.pop(None, []), re.compile(TOKEN)
        for batch in slices(batches, 4096):
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            won: list[str | None] = []
            said: list[str] = []
            for host, path in zip(hosts, paths):
                candidates = list(always)
                for t in set(token.findall(f"{host}/{path}")):
                    candidates += compiled.get(t, ())
                fits = [(-len(p), p, v != "block", v) for p, v, x in candidates if x.match(host + path)]
                best = min(fits, default=None)
                won.append(best[1] if best else None)
                said.append(best[3] if best else default)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(won, pa.string()), pa.array(said, pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"])

    return parsed.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")
