"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a pattern over ``host + path`` in the manner of content-blocking lists:
``||`` anchors at the start of the host or of one of its parent domains, ``|`` at the
start or end, ``^`` stands for a separator or the end, ``*`` for anything; the rest is
literal.  A literal token is a run of ``[a-z0-9]`` that ends on both sides at another
literal character or an anchor, so it is a whole token of every URL the rule fits.

Each rule is filed under the one of its tokens that is rarest in the pages' own URLs
(counted over all of them); a URL's tokens fetch candidate rules, and regular expressions
run on these alone.  Rules without a token are candidates for every URL.  Up to
``BROADCAST_RULES`` rules the index is a constant of the plan, an array of buckets by the
token's checksum, so that a fetch looks at one bucket whatever the number of rules, and
nothing is shuffled; beyond that, URLs' tokens are joined to the index.

Of the fitting site rules the longest wins (ties: block first, then the rule's text); a
URL that none of them fits gets the pattern rules' verdict: block if one fits and no
exception does, else allow.

Edge cases: a null url, or one without ``://``, has empty host and path, no rule and the
verdict allow; repeated rows each get a row; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

BROADCAST_RULES = 5_000
#: Candidates for every URL are filed under this; no URL token contains a space.
NO_TOKEN = " "
#: The rule list that comes with the operator.
RULES = Path(__file__).with_name("url_rules.txt")


@dataclass(frozen=True)
class Rule:
    """``site`` rules decide by length; other rules are the method's patterns."""

    name: str
    pattern: str
    verdict: str
    site: bool = False


def site_rule(host: str, path: str, verdict: str) -> Rule:
    return Rule(host + path, "||" + host + path, verdict, True)


def pattern_rule(pattern: str) -> Rule:
    return Rule(pattern, pattern[2:], "allow") if pattern.startswith("@@") else Rule(pattern, pattern, "block")


def read_rules(path: Path | str = RULES) -> list[Rule]:
    """Rules of a list: a pattern a line, or words that become patterns by the last ``@forms`` line; ``!`` begins a comment."""
    patterns, forms = {}, []
    for line in map(str.strip, Path(path).read_text().splitlines()):
        if line.startswith("@forms"):
            forms = line.split()[1:]
        elif line and not line.startswith("!"):
            patterns |= dict.fromkeys([f.format(line) for f in forms] or [line])
    return list(map(pattern_rule, patterns))


def regex(pattern: str, end_of_text: str = "\\z", folded: bool = True) -> str:
    """For a place whose A-Z are lower-cased (if ``folded``); Java and RE2 read it alike, Python (until 3.13) with ``\\Z`` as the end of text.

    ``$`` is none of these: Java lets it stand before a last line break.
    """
    out, body = "", pattern.translate(_LOWER) if folded else pattern
    if body.startswith("||"):
        out, body = "^(?:[^/]*[.])?", body[2:]
    elif body.startswith("|"):
        out, body = "^", body[1:]
    end = body.endswith("|")
    for c in body[: -1 if end else None]:
        out += {"*": "[\\s\\S]*", "^": f"(?:[^A-Za-z0-9_.%-]|{end_of_text})"}.get(c) or (c if re.match("[A-Za-z0-9]", c) else f"[{c}]" if c not in "^\\[]" else "\\" + c)
    return out + (end_of_text if end else "")


def tokens(pattern: str) -> list[str]:
    """Whole tokens of every URL that the pattern fits, lower-cased."""
    body = pattern.translate(_LOWER)
    start, end = body.startswith("|"), body.endswith("|") and len(body) > 1
    body = body.lstrip("|")[: -1 if end else None]
    found = []
    for m in re.finditer("[a-z0-9]+", body):
        left = body[m.start() - 1] if m.start() else "|" if start else "*"
        right = body[m.end()] if m.end() < len(body) else "|" if end else "*"
        # letters beyond ASCII are no token characters on either side, as in url_tokens
        if left != "*" and right != "*":
            found.append(m.group())
    return found


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lowered(place: Column) -> Column:
    """A-Z lower-cased and nothing else, so that no letter becomes two."""
    return F.translate(place, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    rest = F.regexp_extract(url, "^[\\s\\S]*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, "^[\\s\\S]*?://[^/?#]*([^?#]*)", 1)


def url_tokens(place: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(lowered(place), F.lit("[a-z0-9]+"), F.lit(0)))


def rarest_tokens(places: DataFrame, rules: list[Rule]) -> dict[str, list[Rule]]:
    """Token -> rules.  Counts come from all URLs, but only of tokens that rules have, so they are bounded by the rules."""
    mine = {r: tokens(r.pattern) for r in rules}
    wanted = places.sparkSession.createDataFrame([(t,) for t in sorted({t for ts in mine.values() for t in ts})], "token string")
    seen = places.select(F.explode("tokens").alias("token")).join(F.broadcast(wanted) if len(rules) <= BROADCAST_RULES else wanted, "token")
    count = {r["token"]: r["count"] for r in seen.groupBy("token").count().collect()}
    index: dict[str, list[Rule]] = {}
    for r, ts in mine.items():
        index.setdefault(min(ts, key=lambda t: (count.get(t, 0), t)) if ts else NO_TOKEN, []).append(r)
    return index


KIND = "array<struct<name:string,regex:string,verdict:string,site:boolean>>"


def _seen_by(site: Column, place: Column) -> Column:
    """Site rules look at paths as they are, patterns at lower-cased ones."""
    return F.when(site, place).otherwise(lowered(place))


def _entry(r: Rule) -> dict:
    return {**asdict(r), "regex": regex(r.pattern, folded=not r.site)}


def _constant(value: list, kind: str) -> Column:
    """A constant of the plan: folded once, whatever its length."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _fetched(index: dict[str, list[Rule]]) -> Column:
    """Candidates of a row's ``tokens`` by a table of buckets, about one token a bucket."""
    size = 1
    while size < 2 * len(index):
        size *= 2
    buckets: list[list] = [[] for _ in range(size)]
    for token, rules in sorted(index.items()):
        buckets[zlib.crc32(token.encode()) % size].append({"k": token, "v": list(map(_entry, rules))})
    table = _constant(buckets, f"array<array<struct<k:string,v:{KIND}>>>")
    bucket = lambda t: F.get(table, F.pmod(F.crc32(t), F.lit(size)).cast("int"))
    return F.flatten(F.flatten(F.transform("tokens", lambda t: F.transform(F.filter(bucket(t), lambda e: e["k"] == t), lambda e: e["v"]))))


def with_candidates(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """``rows`` (with ``place`` and ``tokens``) and the ``candidates`` that their tokens fetch."""
    index = rarest_tokens(rows, rules)
    always = _constant(list(map(_entry, index.pop(NO_TOKEN, []))), KIND)
    if len(rules) <= BROADCAST_RULES:
        return rows.withColumn("candidates", F.concat(_fetched(index), always))
    filed = rows.sparkSession.createDataFrame([(t, *(_entry(r)[k] for k in ("name", "regex", "verdict", "site"))) for t, rs in index.items() for r in rs], "token string, name string, regex string, verdict string, site boolean")
    each = rows.select("place", "tokens").distinct().select("place", F.explode("tokens").alias("token"))
    fits = each.join(filed, "token").where(F.call_function("rlike", _seen_by(F.col("site"), F.col("place")), F.col("regex"))).groupBy("place").agg(F.collect_list(F.struct("name", "regex", "verdict", "site")).alias("fetched"))
    return rows.join(fits, "place", "left").withColumn("candidates", F.concat(F.coalesce("fetched", _constant([], KIND)), always)).drop("fetched")


def judge(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """``page_id, host, path, rule, verdict, patterns, n_candidates`` for every row of ``pages``; ``patterns`` are those that fit, exceptions too."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path")).withColumn("place", F.concat("host", "path"))
    found = with_candidates(rows.withColumn("tokens", url_tokens(F.col("place"))), rules)
    fitting = F.filter("candidates", lambda c: F.call_function("rlike", _seen_by(c["site"], F.col("place")), c["regex"]))
    judged = found.withColumn("n_candidates", F.size("candidates")).withColumn("fits", fitting)
    sites = F.array_sort(F.transform(F.filter("fits", lambda c: c["site"]), lambda c: F.struct((-F.length(c["name"])).alias("n"), (c["verdict"] != "block").alias("v"), c["name"].alias("name"), c["verdict"].alias("verdict"))))
    judged = judged.withColumn("site", F.get(sites, F.lit(0))).withColumn("patterns", F.filter("fits", lambda c: ~c["site"]))
    blocked = F.exists("patterns", lambda c: c["verdict"] == "block") & ~F.exists("patterns", lambda c: c["verdict"] == "allow")
    return judged.select(
        "page_id", "host", "path", F.col("site.name").alias("rule"),
        F.coalesce(F.col("site.verdict"), F.when(blocked, "block").otherwise("allow")).alias("verdict"),
        F.array_join(F.array_sort(F.transform("patterns", lambda c: c["name"])), ",").alias("patterns"), "n_candidates",
    )


def rule_hits(judged: DataFrame) -> DataFrame:
    """``pattern, urls, decided``: how many URLs each pattern fits, and how many of them no site rule had decided."""
    each = judged.where("patterns <> ''").select("rule", F.explode(F.split("patterns", ",")).alias("pattern"))
    return each.groupBy("pattern").agg(F.count(F.lit(1)).alias("urls"), F.count_if(F.col("rule").isNull()).alias("decided"))
