"""Judging URLs by fixed rules, and the rest by association rules mined from labelled URLs.

Spark's FP-growth mines combinations of URL tokens that come with a `block` label on a bounded
labelled sample. Rules of enough support and confidence are kept unless a part of their tokens
already makes a rule as confident, and are held as an inverted index: a URL posts its tokens, and
a rule matches when all of its tokens were posted. Judging a table is one narrow pass.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settled, table

#: (verdict, host, path): a rule fits its host and all subdomains where the URL's path starts with its path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Bounds of the mined model: labelled rows it is fitted on (chosen by a hash of the id), tokens of a labelled URL, rules.
MAX_LABELLED_ROWS, MAX_TOKENS, MAX_RULES = 20_000, 12, 10_000
MIN_ROWS, MIN_CONFIDENCE = 10, 0.7
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLOCK = "block"  # no token: those have a colon


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for a null or a URL without `://`."""
    after = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1))
    return F.translate(F.coalesce(after, F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty for a null or a URL without `://`."""
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1)), F.lit(""))


def fixed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; ties go to the first; null if none does."""
    found = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        one = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, one) if found is None else found.when(fits, one)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def url_tokens(url: Column) -> Column:
    """Distinct tokens: labels of the host (h:), its last two (d:), segments of the path (p:, digits as #) and keys of the query (q:)."""
    host, path = host_of(url), F.translate(path_of(url), _UPPER, _LOWER)
    filled = lambda parts: F.filter(parts, lambda x: x != "")
    tagged = lambda tag, parts: F.transform(filled(parts), lambda x: F.concat(F.lit(tag), x))
    segments = F.transform(F.split(path, "/"), lambda s: F.when(s.rlike("^[0-9]+$"), "#").otherwise(s))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda k: F.substring_index(k, "=", 1))
    return F.array_distinct(F.concat(tagged("h:", F.split(host, r"\.")), tagged("d:", F.array(F.substring_index(host, ".", -2))), tagged("p:", segments), tagged("q:", keys)))


@dataclass(frozen=True)
class RuleIndex:
    """Rules by the tokens they ask for; a rule matches when as many of its tokens were posted as it has."""

    sizes: tuple[int, ...]
    confidences: tuple[float, ...]
    postings: dict[str, tuple[int, ...]]

    @staticmethod
    def of(rules: Iterable[tuple[frozenset[str], float]]) -> RuleIndex:
        """Without rules that ask for more tokens than another one without being more confident."""
        kept: list[tuple[frozenset[str], float]] = []
        holders: dict[str, list[int]] = {}
        for tokens, confidence in sorted(rules, key=lambda r: (len(r[0]), -r[1], sorted(r[0]))):
            hits = Counter(i for t in tokens for i in holders.get(t, ()))
            if any(n == len(kept[i][0]) and kept[i][1] >= confidence for i, n in hits.items()):
                continue
            for t in tokens:
                holders.setdefault(t, []).append(len(kept))
            kept.append((tokens, confidence))
        return RuleIndex(tuple(len(t) for t, _ in kept), tuple(c for _, c in kept), {t: tuple(i) for t, i in holders.items()})

    def confidence(self, tokens: Iterable[str]) -> float | None:
        """The highest confidence of a rule that matches."""
        hits = Counter(i for t in set(tokens) for i in self.postings.get(t, ()))
        return max((self.confidences[i] for i, n in hits.items() if n == self.sizes[i]), default=None)


def labelled_urls(pages: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED_ROWS) -> DataFrame:
    """(tokens, bad) of at most `max_rows` pages with a label of their id; bad: of quality 0 or toxic.

    Null ids and labels other than 0 and 1 are left out; of repeated labels the worst counts, of repeated pages the least URL.
    """
    good = F.col("quality").isin(0, 1) & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    own = labels.where(good).groupBy(F.col("doc_id").alias("_id")).agg((F.max(bad) == 1).alias("bad"))
    urls = pages.where("page_id is not null and url is not null").groupBy(F.col("page_id").alias("_id")).agg(F.min("url").alias("url"))
    chosen = urls.join(own, "_id").orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    return chosen.select("_id", url_tokens(F.col("url")).alias("tokens"), "bad")


def mine_rules(sample: DataFrame, min_rows: int = MIN_ROWS, min_confidence: float = MIN_CONFIDENCE, max_tokens: int = MAX_TOKENS, max_rules: int = MAX_RULES) -> RuleIndex:
    """Token combinations of at least `min_rows` bad rows of the bounded sample, of which at least `min_confidence` are bad.

    Of a URL the `max_tokens` frequent tokens with the largest bad share are mined; of all rules found the `max_rules`
    most confident (ties: most frequent) stay. No labelled rows, or none that are bad, give no rules.
    """
    from pyspark.ml.fpm import FPGrowth

    sample = settled(sample)
    n = sample.count()
    if not n:
        return RuleIndex.of([])
    each = sample.select("_id", "bad", F.explode("tokens").alias("token"))
    share = each.groupBy("token").agg(F.count("*").alias("n"), F.count_if("bad").alias("n_bad")).where(F.col("n_bad") >= min_rows)
    ranked = each.join(share, "token").groupBy("_id", "bad").agg(F.sort_array(F.collect_list(F.struct((-F.col("n_bad") / F.col("n")).alias("less"), "token"))).alias("t"))
    items = F.transform(F.slice("t", 1, max_tokens), lambda x: x.token)
    baskets = settled(ranked.select(F.when(F.col("bad"), F.array_append(items, F.lit(_BLOCK))).otherwise(items).alias("items")))
    if baskets.isEmpty():
        return RuleIndex.of([])
    total = baskets.count()
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (min_rows - 0.5) / total), minConfidence=min_confidence).fit(baskets)
    found = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == _BLOCK))
    best = found.select(F.sort_array("antecedent").alias("tokens"), "confidence", "support").orderBy(F.desc("confidence"), F.desc("support"), "tokens").limit(max_rules)
    return RuleIndex.of((frozenset(r.tokens), r.confidence) for r in best.collect())


def judged(pages: DataFrame, index: RuleIndex, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """The rows of `pages` (page_id, url) as (page_id, host, path, rule, verdict, confidence), one each.

    `confidence` is that of the best mined rule that matches, null if none does; a URL without a fixed rule is
    blocked if one matches. Null URLs have an empty host and path and are allowed.
    """

    @F.pandas_udf("double")
    def confidence(tokens: pd.Series) -> pd.Series:
        return tokens.map(index.confidence).astype("float64")

    url = F.col("url")
    parts = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), confidence(url_tokens(url)).alias("confidence"))
    ruled = parts.withColumn("fixed", fixed_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("fixed.verdict", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow"))
    return ruled.select("page_id", "host", "path", F.col("fixed.rule").alias("rule"), verdict.alias("verdict"), "confidence")


def op11_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    index = mine_rules(labelled_urls(pages, table(spark, sf_dir, "labels")))
    return judged(pages, index).drop("confidence")


_TOKENS_SQL = r"""list_distinct(list_concat(
  list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x),
  CASE WHEN host = '' THEN [] ELSE ['d:' || regexp_extract(host, '([^.]*\.)?[^.]*$')] END,
  list_transform(list_filter(string_split(translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '/'), lambda x: x <> ''), lambda x: 'p:' || CASE WHEN regexp_full_match(x, '[0-9]+') THEN '#' ELSE x END),
  list_transform(list_filter(list_transform(string_split(regexp_extract(coalesce(url, ''), '(?s)^[^?#]*\?([^#]*)', 1), '&'), lambda x: string_split(x, '=')[1]), lambda x: x <> ''), lambda x: 'q:' || x)))"""
#: Every set of a labelled URL's frequent tokens is counted, which suits a small sample of URLs of at most 12 tokens.
OP11_SQL = rf"""WITH parts AS (SELECT page_id, url, translate(CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1) ELSE '' END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
tok AS (SELECT *, {_TOKENS_SQL} AS tokens FROM parts),
own AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE quality IN (0, 1) AND toxic IN (0, 1) GROUP BY doc_id),
sample AS (SELECT page_id, bad, tokens FROM tok JOIN own ON doc_id = page_id WHERE url IS NOT NULL),
frequent AS (SELECT token FROM (SELECT bad, unnest(tokens) AS token FROM sample) GROUP BY token HAVING sum(bad) >= {MIN_ROWS}),
kept AS (SELECT bad, list_sort(list_intersect(tokens, known)) AS t FROM sample, (SELECT coalesce(list(token), []) AS known FROM frequent)),
sets AS (SELECT bad, list_filter(t, lambda x, i: (CAST(m AS BIGINT) >> (i - 1)) & 1 = 1) AS s FROM (SELECT bad, t, unnest(range(1, CAST(2 ** len(t) AS BIGINT))) AS m FROM kept)),
mined AS (SELECT s FROM sets GROUP BY s HAVING sum(bad) >= {MIN_ROWS} AND sum(bad) / count(*) >= {MIN_CONFIDENCE}),
fixed AS (SELECT page_id, host, path, tokens, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/' WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM tok)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN EXISTS (SELECT 1 FROM mined WHERE list_has_all(tokens, s)) THEN 'block' ELSE 'allow' END AS verdict FROM fixed"""
