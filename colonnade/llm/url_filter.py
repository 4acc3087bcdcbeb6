"""URL filters: host and path rules, and boosted trees over lexical features for the rest, with DataFrame functions only.

Labelled URLs train the trees. Where no table of labels exists, `seeded` labels URLs by words in their host names; the
trees see only shape (lengths, depth, digits, entropy, parameters, marks in the host) and the share of blocked URLs per
host suffix among all labelled URLs. The trees fit on a bounded sample; the suffix counts are a table of every suffix.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.llm.runtime import stored

# Fixed values: (verdict, host and path)
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
# Words of host names that mark unwanted sites: gambling, adult, pharmacy, advertising, spam.
SEEDS = ("casino", "bet", "bets", "poker", "slots", "adult", "xxx", "porn", "sex", "pills", "pharmacy", "viagra", "ads", "adserver", "tracker", "track", "spam", "warez")
FEATURES = ("url_length", "host_length", "path_length", "host_labels", "depth", "digit_ratio", "host_digits", "entropy", "host_entropy",
            "parameters", "query_length", "has_fragment", "host_marks", "longest_label", "vowel_ratio", "suffix_share", "suffix_seen", "top_share")
BLOCK_FROM = 0.5
PRIOR = 2.0  # rows that a suffix's share counts as having seen at the overall share
FOLDS = 4  # a training row's suffix counts leave out its own fold of urls, so a rare suffix does not give its label away
HOT_SHARE, SPREAD = 64, 32  # a suffix of more than one in HOT_SHARE rows meets its counts in SPREAD parts


def _text(url: Column) -> Column:
    return F.coalesce(url.cast("string"), F.lit(""))


def host_of(url: Column) -> Column:
    """What lies between the first `://` and `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    return F.translate(F.regexp_extract(_text(url), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.regexp_extract(_text(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does; of equally long ones the first given."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        own_host, slash, rest = text.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def entropy(text: Column) -> Column:
    """Bits per character of the characters' frequencies; 0 for an empty text."""
    chars = F.array_remove(F.split(text, ""), "")
    n = F.size(chars).cast("double")
    one = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    bits = F.aggregate(F.transform(F.array_sort(F.array_distinct(chars)), lambda c: -one(c) * F.log2(one(c))), F.lit(0.0), lambda a, x: a + x)
    return F.when(n > 0, bits).otherwise(0.0)


def suffix(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


def shape(pages: DataFrame) -> DataFrame:
    """The rows with host, path and every feature that needs no training; a null url has those of the empty text."""
    url, host, path = _text(F.col("url")), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    ratio = lambda text, pattern: F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text), F.lit(1))
    made = {
        "url_length": F.length(url), "host_length": F.length("host"), "path_length": F.length("path"),
        "host_labels": F.size(F.split(host, r"\.")), "depth": F.size(F.array_remove(F.split(path, "/"), "")),
        "digit_ratio": ratio(url, r"[0-9]"), "host_digits": ratio(host, r"[0-9]"), "entropy": entropy(url), "host_entropy": entropy(host),
        "parameters": F.size(F.array_remove(F.split(query, "&"), "")), "query_length": F.length(query), "has_fragment": F.instr(url, "#") > 0,
        "host_marks": F.regexp_count(host, F.lit(r"[-_]")), "longest_label": F.aggregate(F.split(host, r"\."), F.lit(0), lambda a, x: F.greatest(a, F.length(x))),
        "vowel_ratio": ratio(host, r"[aeiou]"),
    }
    return pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))).withColumns({k: v.cast("double") for k, v in made.items()})


def seeded(pages: DataFrame, seeds=SEEDS) -> DataFrame:
    """(url, label) of every distinct url: 1 (to block) where a word of the host is a seed, words being split at dots, dashes and underscores."""
    words = F.split(host_of(F.col("url")), r"[._-]")
    label = F.arrays_overlap(words, F.array(*[F.lit(s) for s in seeds])).cast("int")
    return pages.filter("url IS NOT NULL").select("url", label.alias("label")).distinct()


def suffixes(host: Column) -> Column:
    """The suffixes of one and two labels."""
    return F.array_distinct(F.array(suffix(host, 1), suffix(host, 2)))


def _fold(url: Column) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(FOLDS)).cast("int")


def suffix_counts(labelled: DataFrame) -> DataFrame:
    """(suffix, n, bad, own) of every suffix of the labelled urls: its urls, those to block, and an array of both per fold."""
    each = labelled.select("label", _fold(F.col("url")).alias("fold"), F.explode(suffixes(host_of(F.col("url")))).alias("suffix"))
    own = [F.struct(F.count_if(F.col("fold") == k).alias("n"), F.count_if((F.col("fold") == k) & (F.col("label") == 1)).alias("bad")) for k in range(FOLDS)]
    return each.groupBy("suffix").agg(F.count("*").alias("n"), F.sum("label").alias("bad"), F.array(*own).alias("own"))


def hot_suffixes(rows: DataFrame) -> list[str]:
    """The suffixes of more than one in `HOT_SHARE` of the rows with a host: at most twice that many."""
    n = rows.count()
    counts = rows.select(F.explode(suffixes(F.col("host"))).alias("suffix")).groupBy("suffix").agg(F.count("*").alias("n"))
    return sorted(r["suffix"] for r in counts.filter(F.col("n") * HOT_SHARE > n).collect())


def _with_shares(rows: DataFrame, counts: DataFrame, overall: float, hot: list[str], training: bool = False) -> DataFrame:
    """The rows with the features of their suffixes. Hot suffixes are dealt by the hash of the row over `SPREAD` parts."""
    columns = rows.columns
    parts = F.when(F.col("suffix").isin(hot), F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
    known = counts.select(F.col("suffix").alias("_suffix"), F.struct("n", "bad", "own").alias("_found"), F.explode(parts).alias("_part"))
    for name, labels in (("_near", 2), ("_top", 1)):
        dealt = F.when(F.col("_key").isin(hot), F.pmod(F.xxhash64(*columns), F.lit(SPREAD)).cast("int")).otherwise(0)
        keyed = rows.withColumn("_key", suffix(F.col("host"), labels)).withColumn("_dealt", dealt)
        met = keyed.join(known, (F.col("_key") == F.col("_suffix")) & (F.col("_dealt") == F.col("_part")), "left")
        rows = met.withColumnRenamed("_found", name).drop("_key", "_dealt", "_suffix", "_part")

    def total(name: str, field: str) -> Column:
        found = F.col(name)[field]
        return F.coalesce(found - F.col(name)["own"][_fold(F.col("url"))][field] if training else found, F.lit(0))

    share = lambda name: (total(name, "bad") + PRIOR * overall) / (total(name, "n") + PRIOR)
    return rows.withColumns({"suffix_share": share("_near"), "suffix_seen": F.log1p(total("_near", "n").cast("double")), "top_share": share("_top")}).drop("_near", "_top")


class UrlModel:
    """Trees and the table of suffix counts; `blocked` adds the probability of a block."""

    def __init__(self, trees: PipelineModel | None, counts: DataFrame | None, overall: float):
        self.trees, self.counts, self.overall = trees, counts, overall

    def featured(self, pages: DataFrame) -> DataFrame:
        rows = pages.withColumn("host", host_of(F.col("url")))
        return shape(_with_shares(rows, self.counts, self.overall, hot_suffixes(rows)))

    def blocked(self, pages: DataFrame) -> DataFrame:
        """The rows with host, path and probability."""
        if self.trees is None:
            return shape(pages).withColumn("probability", F.lit(self.overall))
        scored = self.trees.transform(self.featured(pages))
        return scored.withColumn("probability", vector_to_array("probability")[1]).drop("_x", "rawPrediction", "prediction")


def fit(labelled: DataFrame, bound: int = 20_000, trees: int = 20, depth: int = 4) -> UrlModel:
    """Trees from at most `bound` rows of (url, label), of each label up to half, those of the smallest md5 of the url.

    Suffix shares cover every suffix of one and two labels of all rows; only suffixes that no row has count as unseen.
    With one label only, every url gets that label's share.
    """
    clean = labelled.select(F.col("url").cast("string").alias("url"), F.col("label").cast("int").alias("label")).filter("url IS NOT NULL AND label IN (0, 1)")
    n, overall = clean.agg(F.count("*"), F.avg("label")).first()
    if not n or overall in (0.0, 1.0):
        return UrlModel(None, None, float(overall or 0.0))
    counts = stored(suffix_counts(clean), "suffixes")
    halves = [clean.filter(F.col("label") == k).orderBy(F.md5(F.col("url").cast("binary")), "url").limit(bound // 2) for k in (0, 1)]
    sample = halves[0].unionByName(halves[1]).withColumn("host", host_of(F.col("url"))).repartition(4, "url")
    rows = shape(_with_shares(sample, counts, overall, [], training=True)).cache()
    try:
        # equal weight to both labels, whatever their numbers in the sample
        share = rows.agg(F.avg("label")).first()[0]
        weighted = rows.withColumn("weight", F.when(F.col("label") == 1, 0.5 / share).otherwise(0.5 / (1 - share)))
        assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="_x")
        boosted = GBTClassifier(labelCol="label", featuresCol="_x", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=11)
        model = boosted.fit(assembler.transform(weighted))
        return UrlModel(PipelineModel([assembler, model]), counts, float(overall))
    finally:
        rows.unpersist()


def judged(pages: DataFrame, model: UrlModel, rules=RULES) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, probability.

    The longest fitting rule decides; without one the trees do. Rows are neither dropped nor combined; other columns are
    not read.
    """
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    scored = model.blocked(pages.select("page_id", "url"))
    own = F.when(F.col("probability") >= BLOCK_FROM, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "probability")
