"""URL filter: host rules first, then a weighted vocabulary found with one Aho-Corasick pass."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import with_result

#: A term of this weight or more is strict: one occurrence rejects. Lighter terms are soft.
STRICT = 10
#: Terms in lower case with their weights. A term counts only as a whole word of the url.
VOCABULARY: dict[str, int] = {
    "porn": 10, "xxx": 10, "hentai": 10, "camgirls": 10, "escorts": 10, "nudes": 10, "warez": 10, "phishing": 10,
    "malware": 10, "link-farm": 10, "viagra": 10, "cialis": 10,
    "adult": 1, "sex": 2, "sexy": 2, "dating": 1, "casino": 2, "poker": 1, "bet": 1, "betting": 1, "slots": 1,
    "jackpot": 1, "loan": 1, "payday": 1, "pills": 1, "pharmacy": 1, "replica": 1, "torrent": 1, "crack": 1,
    "keygen": 2, "spam": 2, "farm": 1, "clickbait": 1, "popups": 1, "giveaway": 1, "cheap": 1, "free": 1,
}
#: Up to this many rules are one expression; more are looked up by host.
EXPRESSION_RULES = 500
Rule = tuple[str, bool]


def host_of(url: str = "url") -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    text = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), "://([^/?#]*)", 1)
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str = "url") -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), "://[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: Iterable[Rule]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits; nulls where none does.

    A rule `host/path` fits its host and all subdomains when the url's path
    starts with `/path`. Of two fitting rules of one length, the longer host wins.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[0]), -r[0].index("/"), r[0]))
    if len(ordered) > EXPRESSION_RULES:
        found = _rule_lookup(ordered)(host, path)
        return found["rule"], found["verdict"]
    found = verdict = F.lit(None).cast("string")
    for text, allow in reversed(ordered):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(text)).otherwise(found)
        verdict = F.when(fits, F.lit("allow" if allow else "block")).otherwise(verdict)
    return found, verdict


def _rule_lookup(ordered: list[Rule]):
    """UDF of host and path for any number of rules: those of the host and of each domain above it, the first in order that fits."""
    by_host: dict[str, list[tuple[int, str, str, str]]] = {}
    for place, (text, allow) in enumerate(ordered):
        name, slash, rest = text.partition("/")
        by_host.setdefault(name, []).append((place, slash + rest, text, "allow" if allow else "block"))
    kind = pa.struct([("rule", pa.string()), ("verdict", pa.string())])

    @F.arrow_udf("rule string, verdict string")
    def look(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        out = []
        for host, path in zip(hosts.to_pylist(), paths.to_pylist()):
            best, rest = None, host
            while True:
                best = min([r for r in by_host.get(rest, ()) if path.startswith(r[1])] + ([best] if best else []), default=None)
                if "." not in rest:
                    break
                rest = rest.partition(".")[2]
            out.append({"rule": best and best[2], "verdict": best and best[3]})
        return pa.array(out, kind)

    return look


def read_vocabulary(path: str) -> dict[str, int]:
    """Terms with weights from a text file of `term<TAB>weight` lines; empty lines and those that begin with # are left out."""
    with open(path, encoding="utf-8") as f:
        rows = [line.rstrip("\n").split("\t") for line in f if line.strip() and not line.startswith("#")]
    return {term: int(weight) for term, weight in rows}


def vocabulary_hits(vocabulary: Mapping[str, int] = VOCABULARY):
    """UDF of a url: occurrences of terms, each bounded by characters outside [a-z0-9] on both sides.

    The url is read as it is; A-Z are folded in it and in the terms, of two equal terms the heavier counts. Result per url: distinct strict terms,
    distinct soft terms, their summed weight, and occurrences of all terms.
    """
    fold = {c: c + 32 for c in range(65, 91)}
    terms: dict[str, int] = {}
    for t, w in vocabulary.items():
        if t:
            terms[t.translate(fold)] = max(int(w), terms.get(t.translate(fold), 0))
    kind = pa.struct([("strict_terms", pa.list_(pa.string())), ("soft_terms", pa.list_(pa.string())),
                      ("soft_weight", pa.int64()), ("occurrences", pa.int64())])
    held: list = []

    @F.arrow_udf("strict_terms array<string>, soft_terms array<string>, soft_weight long, occurrences long")
    def hits(urls: pa.Array) -> pa.Array:
        import ahocorasick

        if not held:
            machine = ahocorasick.Automaton()
            for t in terms:
                machine.add_word(t, t)
            if terms:
                machine.make_automaton()
            held.append(machine)
        word = set("abcdefghijklmnopqrstuvwxyz0123456789")
        rows = []
        for url in urls.to_pylist():
            text = (url or "").translate(fold)
            counts: dict[str, int] = {}
            for end, term in held[0].iter(text) if terms else ():
                first = end + 1 - len(term)
                if (first == 0 or text[first - 1] not in word) and (end + 1 == len(text) or text[end + 1] not in word):
                    counts[term] = counts.get(term, 0) + 1
            soft = sorted(t for t in counts if terms[t] < STRICT)
            rows.append({"strict_terms": sorted(t for t in counts if terms[t] >= STRICT), "soft_terms": soft,
                         "soft_weight": sum(terms[t] for t in soft), "occurrences": sum(counts.values())})
        return pa.array(rows, kind)

    return hits


def filter_urls(pages: DataFrame, url: str = "url", rules: Iterable[Rule] = (), vocabulary: Mapping[str, int] = VOCABULARY,
                min_soft: int = 2, soft_limit: int = 3) -> DataFrame:
    """Judge every url: adds host, path, rule, verdict and the terms found; keeps all rows and other columns.

    The longest fitting rule decides. Without one, the url is blocked by one
    strict term, or by `min_soft` distinct soft terms that weigh `soft_limit`
    or more together. A null or empty url has no terms and is allowed. Rows are
    judged one by one, so repeated rows and ties need no order. Input columns
    named like a result column are replaced.
    """
    hits = vocabulary_hits(vocabulary)(F.col(url))
    judged = with_result(pages, "_url_hits", hits)
    host, path = host_of(url), path_of(url)
    rule, by_rule = matched_rule(host, path, rules)
    by_terms = F.when((F.size("_url_hits.strict_terms") > 0) | ((F.size("_url_hits.soft_terms") >= min_soft) & (F.col("_url_hits.soft_weight") >= soft_limit)), "block").otherwise("allow")
    results = {"host": host, "path": path, "rule": rule, "verdict": F.coalesce(by_rule, by_terms)}
    results |= {c: F.col(f"_url_hits.{c}") for c in ("strict_terms", "soft_terms", "soft_weight", "occurrences")}
    taken = {c.lower() for c in results} | {"_url_hits"}
    return judged.select(*[F.col(f"`{c}`") for c in judged.columns if c.lower() not in taken], *[c.alias(n) for n, c in results.items()])
