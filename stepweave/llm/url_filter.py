"""Allow and block rules for URLs.

Every rule is a regular expression on ``host + path`` with the literal tokens
that a URL must have for it to match.  A rule is indexed under its rarest token
in the corpus at hand (counted over all URLs); a URL's tokens fetch the rules to
try, and only those run their expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import ascii_lower

_TOKEN = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")
TOKEN = "[0-9a-z\\x{80}-\\x{10FFFF}]+"
# Words of hosts and paths that the queries' own rules block.
BLOCKED = tuple(
    "spam adult casino phishing malware porn xxx sex escort poker betting bet gambling slots jackpot lottery viagra cialis pharma pills payday loan loans forex torrent torrents warez crack cracks keygen "
    "serial serials nulled pirate piracy hack hacks botnet ransomware trojan spyware adware popup popups clickbait doubleclick adserver adservice ads advert adverts banner banners sponsor sponsored tracker trackers tracking pixel "
    "affiliate affiliates redirect redirects clicks cashback giveaway sweepstakes replica counterfeit darkweb onion webcam camgirls nude nudes erotic fetish hentai dating hookup miner cryptominer scam fraud fake "
    "login-verify account-verify parked parking domain-for-sale expired".split()
)
#: Rules travel to every worker; this bounds them.
MOST_RULES = 1_000_000


@dataclass(frozen=True)
class Rule:
    """``name`` is the rule as written; ``tokens`` are in lower case, whole between separators; the longest name wins."""

    name: str
    verdict: str
    pattern: str
    tokens: frozenset[str]
    listed: bool = True


def prefix_rule(verdict: str, name: str) -> Rule:
    """A host with all its subdomains, and a path prefix from the first slash on."""
    host, slash, path = name.partition("/")
    whole = _TOKEN.findall(host.lower() + slash + path)
    if slash and path and _TOKEN.fullmatch(path[-1]):
        whole = whole[:-1]  # the URL's own token may go on
    end = "" if slash else "(?=/|$)"  # a bare host ends where the path begins
    return Rule(name, verdict, rf"(?:[^/]*\.)?{re.escape(host.lower())}{re.escape(slash + path)}{end}", frozenset(t.lower() for t in whole))


def pattern_rule(verdict: str, pattern: str, *tokens: str) -> Rule:
    """A rule of the method's own: it gives a verdict where no listed rule fits."""
    return Rule(pattern, verdict, pattern, frozenset(tokens), listed=False)


def word_rules(verdict: str, words: tuple[str, ...]) -> list[Rule]:
    """For each word a rule for host labels that are the word or begin with it and a hyphen, and one for path segments that are the word."""
    hosts = [pattern_rule(verdict, rf"(?:[^/]*\.)?{re.escape(w)}(?:[-.][^/]*)?(?=/|$)", *_TOKEN.findall(w)) for w in words]
    return hosts + [pattern_rule(verdict, rf"[^/]*(?:/[^/]*)*?/{re.escape(w)}(?=/|$)", *_TOKEN.findall(w)) for w in words]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null or without ``://``; a host of A-Z in lower case; a path from there to the query or fragment."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return ascii_lower(host), F.regexp_extract(F.substr(rest, F.length(host) + F.lit(1)), r"^[^?#]*", 0)


def token_counts(urls: DataFrame, tokens: list[str]) -> dict[str, int]:
    """How many of all URLs have each token of the rules; as many rows as the rules have tokens."""
    wanted = urls.sparkSession.createDataFrame([(t,) for t in tokens], "token string")
    found = urls.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.concat("host", "path")), F.lit(TOKEN), F.lit(0)))).alias("token"))
    return {r.token: r["n"] for r in found.join(F.broadcast(wanted), "token").groupBy("token").agg(F.count("*").alias("n")).collect()}


class Index:
    """Rules under their rarest tokens; rules without a token are tried on every URL."""

    def __init__(self, rules: list[Rule], counts: dict[str, int]):
        self.always: list[tuple[Rule, re.Pattern]] = []
        self.by: dict[str, list[tuple[Rule, re.Pattern]]] = {}
        for r in rules:
            at = self.by.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t)), []) if r.tokens else self.always
            at.append((r, re.compile(r.pattern, re.DOTALL)))

    def judge(self, text: str, default: str) -> tuple[str | None, str]:
        """Rule and verdict for host and path together: the longest listed rule that fits (of equals a block), else the method's, else the default."""
        best = own = None
        for token in {t.lower() for t in _TOKEN.findall(text)} | {None}:
            for r, pattern in self.always if token is None else self.by.get(token, ()):
                if pattern.match(text):
                    key = (len(r.name), r.verdict == "block", r.name)
                    if r.listed and (best is None or key > best[0]):
                        best = (key, r)
                    elif not r.listed and (own is None or key > own[0]):
                        own = (key, r)
        return (best[1].name, best[1].verdict) if best else (None, own[1].verdict if own else default)


def judge_urls(spark: SparkSession, pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict), one row for each input row.

    Null, empty and malformed URLs have an empty host and path, no rule and the
    default verdict.  Ids may be null or repeat; other columns are not read.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} are sent to the workers")
    host, path = host_and_path(F.col(url_col).cast("string"))
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    counts = token_counts(urls, sorted({t for r in rules for t in r.tokens}))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(rules, counts)
        for batch in batches:
            found = [index.judge(h + p, default) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return urls.mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string")
