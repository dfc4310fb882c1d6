"""URL filters by association rules.

A url becomes a set of tokens (scheme, host, its last label, first label, last two labels and
hyphenated words, path parts with numbers made alike, query names, anchor). Spark's FP-growth mines the token sets of labelled
urls, each with its label as one more token. A rule has the label as its consequent, the least
support, and a confidence that is above its label's share of all urls by Z standard errors; a
rule that blocks also needs the least CONFIDENCE, and any rule must improve by IMPROVEMENT on
each of its parts. Rules of one part of the labelled urls are then held against the rest
(`confirmed`): those that do not beat the share there as well are dropped.

Rules are matched by an inverted index: (token, rule) postings are joined with each url's
tokens, and a rule fires when all its tokens are found. Of the rules that fire the one whose
confidence is most standard errors above its label's share decides, then the best supported,
then the longest, then block before allow; without one a url is allowed.

A list of (host, path) rules goes first: the longest that fits decides.

Null urls and urls without `://` have an empty host and path, and no tokens; long urls are
taken whole; repeated rows repeat; null ids pass through; other columns are ignored; without
labelled urls there are no mined rules, and without rows no result.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_side, staged

#: Least share of the labelled urls that a rule and its label hold, and least confidence of a rule that blocks.
SUPPORT, CONFIDENCE = 0.005, 0.5
#: Standard errors by which a rule's confidence is above its label's share of all urls.
Z = 4.0
#: What a rule must add to the confidence of each part of it.
IMPROVEMENT = 0.02
ALLOW, BLOCK = "label=allow", "label=block"
#: (verdict, host, path) of the list that goes before the mined rules.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def listed(host_: Column, path_: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """(verdict, rule) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def tokens(url: Column) -> Column:
    """The distinct tokens of a url; none for one without `://`. Tokens that always come together (each label of a host
    with the host) are one, so that FP-growth does not count their combinations.
    """
    whole = F.coalesce(url, F.lit(""))
    labels = F.split(host(url), r"\.")
    parts = F.transform(F.split(path(url), "/"), lambda p: F.regexp_replace(p, "[0-9]+", "0"))
    names = F.transform(F.split(F.regexp_extract(whole, r"(?s)\?([^#]*)", 1), "[&;]"), lambda q: F.split(q, "=")[0])
    named = lambda kind, xs: F.transform(F.filter(xs, lambda x: ~x.isin("", "0")), lambda x: F.concat(F.lit(kind), x))
    words = F.flatten(F.transform(F.filter(labels, lambda x: x.contains("-")), lambda x: F.split(x, "-")))
    none = F.array().cast("array<string>")
    every = F.concat(
        F.array(F.concat(F.lit("scheme="), F.lower(F.regexp_extract(whole, r"^([A-Za-z0-9+.-]+)://", 1))), F.concat(F.lit("host="), host(url))),
        F.when(F.size(labels) > 1, F.array(F.concat(F.lit("top="), F.element_at(labels, -1)))).otherwise(none),
        F.when(F.size(labels) > 2, F.array(F.concat(F.lit("first="), labels[0]), F.concat(F.lit("site="), F.substring_index(host(url), ".", -2)))).otherwise(none),
        named("word=", words),
        named("path=", parts),
        named("query=", names),
        F.when(whole.contains("#"), F.array(F.lit("anchor"))).otherwise(none),
    )
    return F.when(whole.contains("://"), F.array_distinct(every)).otherwise(none)


_RULES = "rule bigint, verdict string, tokens array<string>, n int, confidence double, support double, z double"


def _above(confidence: Column, share: Column, n: Column) -> Column:
    """Standard errors by which a confidence seen on n urls is above a share."""
    return (confidence - share) / F.sqrt(share * (1 - share) / n)


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, z: float = Z) -> DataFrame:
    """Rules of labelled urls (url, blocked): rule, verdict, tokens, n, confidence, support, z."""
    items = labelled.where("blocked is not null").select(F.array_append(tokens(F.col("url")), F.when(F.col("blocked"), BLOCK).otherwise(ALLOW)).alias("items"))
    items = staged(items, "baskets")
    total, blocked = items.agg(F.count(F.lit(1)), F.coalesce(F.avg(F.array_contains("items", BLOCK).cast("int")), F.lit(0.0))).first()
    if not 0 < blocked < 1:
        return labelled.sparkSession.createDataFrame([], _RULES)
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min(confidence, 1 - blocked)).fit(items)
    rules = model.associationRules.where(F.col("consequent")[0].isin(ALLOW, BLOCK))
    rules = rules.select(F.substring_index(F.col("consequent")[0], "=", -1).alias("verdict"), F.sort_array("antecedent").alias("tokens"), F.size("antecedent").alias("n"), "confidence", "support")
    share = F.when(F.col("verdict") == "block", F.lit(blocked)).otherwise(F.lit(1 - blocked))
    rules = rules.withColumn("z", _above(F.col("confidence"), share, F.col("support") * total / F.col("confidence")))
    rules = rules.where((F.col("z") >= z) & ((F.col("verdict") == "allow") | (F.col("confidence") >= confidence)))
    rules = staged(rules.select(F.xxhash64("verdict", "tokens").alias("rule"), "*"), "rules")
    # a rule that hardly improves on a part of it adds nothing; a part is met at its first token, which the rule holds too
    part = rules.select(F.col("verdict").alias("v"), F.col("tokens").alias("part"), F.col("n").alias("fewer"), F.col("confidence").alias("sure"), F.col("tokens")[0].alias("token"))
    over = rules.select("*", F.explode("tokens").alias("token")).join(part, "token")
    over = over.where((F.col("v") == F.col("verdict")) & (F.col("fewer") < F.col("n")) & (F.col("sure") + IMPROVEMENT > F.col("confidence")) & (F.size(F.array_except("part", "tokens")) == 0))
    return staged(rules.join(over.select("rule").distinct(), "rule", "left_anti"), "pruned")


def _fired(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, by): each rule whose tokens a url holds, by the inverted index. urls: distinct."""
    postings = staged(rules.select("*", F.explode("tokens").alias("token")), "postings")
    found = urls.select("url", F.explode(tokens(F.col("url"))).alias("token")).join(small_side(postings), "token")
    by = F.struct("z", "support", "n", "verdict", "tokens", "confidence", "rule")
    return found.groupBy("url", "rule", "n").agg(F.count(F.lit(1)).alias("hits"), F.first(by).alias("by")).where("hits = n").select("url", "by")


def confirmed(rules: DataFrame, labelled: DataFrame) -> DataFrame:
    """The rules whose confidence on other labelled urls (url, blocked) is above their label's share of these too."""
    known = labelled.where("url is not null and blocked is not null").groupBy("url").agg(F.count(F.lit(1)).alias("rows"), F.count_if("blocked").alias("bad"))
    known = staged(known, "held")
    total, bad = known.agg(F.sum("rows"), F.sum("bad")).first()
    if not total:
        return rules
    # block sorts rules by how many of their urls are bad, allow by how many are not
    seen = _fired(known.select("url"), rules).join(known, "url").groupBy("by.rule").agg(F.sum("rows").alias("rows"), F.sum("bad").alias("bad"))
    good = F.when(F.col("verdict") == "block", F.col("bad") / F.col("rows") > bad / total).otherwise(F.col("bad") / F.col("rows") < bad / total)
    return staged(rules.join(seen, "rule").where(good).select(*rules.columns), "confirmed")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The deciding rule of each distinct url that some rule fits: url, verdict, mined (its tokens), confidence."""
    best = _fired(urls.where("url is not null").select("url").distinct(), rules).groupBy("url").agg(F.max("by").alias("by"))
    return best.select("url", F.col("by.verdict").alias("verdict"), F.array_join("by.tokens", " ").alias("mined"), F.col("by.confidence").alias("confidence"))


def learn(labelled: DataFrame) -> DataFrame:
    """Rules mined on two thirds of the labelled urls (url, blocked) and confirmed on the others; a url is on one side only."""
    side = F.coalesce(F.crc32(F.col("url").cast("binary")) % 3 == 1, F.lit(False))
    return confirmed(mine(labelled.where(~side)), labelled.where(side))


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, blocked) of the pages of labelled documents: a page shows the document whose number is in its path, and
    quality 0 is what should be blocked. labels: doc_id, quality.
    """
    number = F.nullif(F.regexp_extract(path(F.col("url")), "/([0-9]{1,18})(?:[^0-9/][^/]*)?/?$", 1), F.lit("")).cast("long")
    marked = labels.select(F.col("doc_id").alias("number"), (F.col("quality") == 0).alias("blocked"))
    return pages.select("url", number.alias("number")).where("number is not null").join(marked, "number").select("url", "blocked")


def judge(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, mined, confidence. labelled: url, blocked."""
    rows = pages.select("page_id", "url")
    found = staged(match(rows, learn(labelled)).withColumnRenamed("verdict", "mined_verdict").withColumnRenamed("url", "key"), "matched")
    # a null url meets nothing, and its rows are spread
    key = F.coalesce("url", F.md5(F.col("page_id").cast("string")))
    judged = rows.withColumn("key", key).join(small_side(found), "key", "left").withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    judged = judged.withColumn("fit", listed(F.col("host"), F.col("path")))
    return judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", "mined_verdict", F.lit("allow")).alias("verdict"), "mined", "confidence")
