"""Incident memory: signatures, archive, precedents, outcomes, accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import classify
from ..plans import scan
from .incidents import INCIDENT
from .templates import keep_last_n

# fixed values: weight of each part of a signature
WEIGHTS = {"templates": 0.35, "cause_tokens": 0.25, "detectors": 0.2, "services": 0.1, "severity": 0.1}
OUTCOMES = ("worked", "did_not_work", "wrong_diagnosis")


def incident_signature(members: DataFrame) -> DataFrame:
    """M1: what an incident looked like, as sorted distinct sets (bounded vocabularies)."""
    m = members.where("incident_no is not null")
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    first_line = F.min_by(F.get("evidence", F.lit(0)), F.when(F.size("evidence") > 0, F.col("signal_no")))
    return m.groupBy(*INCIDENT).agg(
        F.min_by("ts", "signal_no").alias("opened_at"),
        F.min("severity").alias("severity"),
        F.sort_array(F.collect_set(filled("service"))).alias("services"),
        F.sort_array(F.collect_set(filled("detector"))).alias("detectors"),
        F.sort_array(F.collect_set(filled("template_id"))).alias("templates"),
        F.sort_array(F.collect_set(F.when(F.col("detector") == "ConformanceRate", F.col("metric")))).alias("deviation_types"),
        first_line.alias("cause"),
    ).withColumn("cause_tokens", classify.cause_tokens(F.coalesce("cause", F.lit("")))).withColumn(
        "cause", F.left("cause", F.lit(200))
    )


def archive_incidents(signatures: DataFrame, archive: DataFrame | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """M2: upsert by (source, incident number, opening time), all of them unless ``archive_kept`` sets a number per source.

    A row archived again keeps the outcome and note it already has.
    """
    key = ["source_id", "incident_no", "opened_at"]
    fresh = signatures.withColumns({
        c: F.lit(None).cast("string") for c in ("outcome", "outcome_note") if c not in signatures.columns
    })
    if archive is None:
        merged = fresh
    else:
        value = [c for c in fresh.columns if c not in key]
        old = archive.select(*key, *[F.col(c).alias(f"__{c}") for c in value])
        pick = [
            F.coalesce(f"__{c}", c).alias(c) if c.startswith("outcome") else F.coalesce(c, f"__{c}").alias(c)
            for c in value
        ]
        merged = fresh.join(old, key, "full_outer").select(*key, *pick)
    if cfg.archive_kept is None:
        return merged
    order = F.struct("opened_at", "incident_no")
    return keep_last_n(merged.withColumn("__o", order), ["source_id"], "__o", cfg.archive_kept).drop("__o")


def _agreement(common: Column, a: Column, b: Column) -> Column:
    """Jaccard index of two distinct sets from the number of their common members."""
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, 0.0).otherwise(common / union)


def with_similarity(pairs: DataFrame, a: str, b: str, need: str | None = None) -> DataFrame:
    """Adds ``similarity``, the weighted agreement of the signatures in the struct columns ``a`` and ``b``.

    Common members are counted once per pair, not once per mention. With ``need``, pairs that cannot reach it by their
    short parts are left out before the longer ones are compared."""
    short, long = ("services", "cause_tokens"), ("templates", "detectors")
    common = lambda parts: {f"__{c}": F.size(F.array_intersect(F.col(f"{a}.{c}"), F.col(f"{b}.{c}"))) for c in parts}
    agreed = {c: _agreement(F.col(f"__{c}"), F.col(f"{a}.{c}"), F.col(f"{b}.{c}")) for c in (*short, *long)}
    agreed["severity"] = F.when((F.col(f"{a}.severity") == F.col(f"{b}.severity")) & (F.col(f"{a}.severity") != ""), 1.0).otherwise(0.0)
    rows = scan.computed_once(pairs.withColumns(common(short)))
    if need is not None:
        reach = sum((F.lit(WEIGHTS[c]) * agreed[c] for c in (*short, "severity")), F.lit(HALF_DIGIT))
        rows = rows.where(reach + sum(WEIGHTS[c] for c in long) >= F.col(need))
    rows = scan.computed_once(rows.withColumns(common(long)))
    score = F.lit(0.0)
    for part, weight in WEIGHTS.items():  # in this order, so that sums are the same everywhere
        score = score + F.lit(weight) * agreed[part]
    return rows.withColumn("similarity", score).drop(*[f"__{c}" for c in (*short, *long)])


#: similarities from which a precedent shares certain parts for sure; a query takes the highest one below its own bar
LEVELS = (0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 0.999)
SETS = ("templates", "cause_tokens", "detectors", "services")
#: similarities are compared at three decimals, as they are read
HALF_DIGIT = 0.0005
#: parts of a list of looks that share a key
LIST_PARTS = 32


def _least_share(part: str, total: float) -> float:
    """What two sets of this part must at least have in common where the whole similarity is over ``total``."""
    return (total - (1.0 - WEIGHTS[part])) / WEIGHTS[part]


def _prefix_keys(terms: Column, least: float, longest: int, asking: bool) -> Column:
    """Keys of which two sets (rarest terms first) share one if their Jaccard index exceeds ``least``.

    Sets of n and m terms then share at least o = least / (1 + least) * (n + m) of them, so one of these is among the first
    n - o + 1 and the first m - o + 1. Where ``least`` is low the sizes are left out and o = least * n."""
    n = F.size(terms)
    first = lambda shared: F.slice(terms, 1, F.greatest(n - F.greatest(shared, F.lit(1)) + 1, F.lit(0)))
    up = lambda x: F.ceil(x - 1e-9).cast("int")
    if least < 0.5:
        return first(up(n * max(least, 0.0)))
    other = F.sequence(F.greatest(up(n * least), F.lit(1)), F.greatest(F.least(F.floor(n / least + 1e-9).cast("int"), F.lit(longest)), up(n * least), F.lit(1)))

    def with_partner(m: Column) -> Column:
        sizes = F.concat_ws("/", *[x.cast("string") for x in ((n, m) if asking else (m, n))])
        return F.transform(first(up((n + m) * (least / (1 + least)))), lambda t: F.concat_ws("/", sizes, t))

    return F.flatten(F.transform(other, with_partner))


def _looks(queries: DataFrame, archive: DataFrame) -> DataFrame:
    """``source_id, class, asked, archived, *parts`` and the sets with their rarest terms first (``by_*``), one row per look."""
    parts = [*SETS, "severity"]
    both = queries.select("source_id", "class", *parts, F.lit(True).alias("asked")).unionByName(
        archive.select("source_id", "class", *parts, F.lit(False).alias("asked")))
    looks = scan.durable(both.groupBy("source_id", "class").agg(
        *[F.first(c).alias(c) for c in parts], F.bool_or("asked").alias("asked"), F.bool_or(~F.col("asked")).alias("archived")))
    marked = lambda c: F.transform(c, lambda t: F.struct(F.lit(c).alias("part"), t.alias("term")))
    terms = looks.select("source_id", "class", F.inline(F.flatten(F.array(*[marked(c) for c in SETS]))))
    common = terms.groupBy("source_id", "part", "term").agg(F.count(F.lit(1)).alias("n"))
    placed = terms.join(common, ["source_id", "part", "term"]).groupBy("source_id", "class").agg(*[
        F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == c, F.struct("n", "term")))), lambda x: x["term"]).alias(f"by_{c}") for c in SETS])
    none = F.array().cast("array<string>")
    return looks.join(placed, ["source_id", "class"], "left").withColumns({f"by_{c}": F.coalesce(f"by_{c}", none) for c in SETS})


def _bars(looks: DataFrame, archive: DataFrame, top: int, cfg: Config) -> DataFrame:
    """``source_id, q, bar``: a similarity that ``top + 1`` incidents are known to reach, one of which may be the asked one.

    Known from shelves: the newest incidents with the same look, with some parts of it the same, and with the same but for one
    template or one detector more or less."""
    whole = ["templates", "cause_tokens", "detectors", "services", "severity"]
    some = [whole, *[[c for c in whole if c != part] for part in whole], ["templates", "cause_tokens"], ["detectors", "services", "severity"]]

    def but_one(part: str) -> Column:
        rest = [c for c in whole if c != part]
        less = F.transform(F.col(part), lambda x: F.array_remove(F.col(part), x))
        return F.transform(F.concat(F.array(F.col(part)), less), lambda left: F.xxhash64(F.lit(part), left, *rest))

    shelf = F.explode(F.concat(F.array(*[F.xxhash64(F.lit(i), *keys) for i, keys in enumerate(some)]), but_one("templates"), but_one("detectors")))
    newest = Window.partitionBy("source_id", "shelf").orderBy(F.desc("opened_at"), F.desc("incident_no"))
    on_shelf = archive.select("source_id", "class", "opened_at", "incident_no", shelf.alias("shelf")).withColumn("r", F.row_number().over(newest)).where(F.col("r") <= top + 1)
    found = looks.where("asked").select("source_id", F.col("class").alias("q"), shelf.alias("shelf")).join(on_shelf, ["source_id", "shelf"])
    known = found.groupBy("source_id", "q", F.col("class").alias("p")).agg(F.countDistinct("opened_at", "incident_no").alias("n"))
    scored = _scored(known, looks).select("source_id", "q", "similarity", "n")
    along = Window.partitionBy("source_id", "q").orderBy(F.desc("similarity"))
    reached = scored.withColumn("upto", F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("upto") > top)
    return reached.groupBy("source_id", "q").agg(F.max(F.round("similarity", 3)).alias("bar"))


def _scored(pairs: DataFrame, looks: DataFrame) -> DataFrame:
    parts = F.struct(*SETS, "severity")
    side = lambda name, kind: looks.where(kind).select("source_id", F.col("class").alias(name), parts.alias(f"{name}s"))
    return with_similarity(pairs.join(side("q", "asked"), ["source_id", "q"]).join(side("p", "archived"), ["source_id", "p"]), "qs", "ps").drop("qs", "ps")


def _candidates(looks: DataFrame, bars: DataFrame, cfg: Config) -> DataFrame:
    """``source_id, q, p, similarity`` of all pairs of looks that reach the asked one's bar."""
    # like the archive's vocabulary, the longest set is one number
    longest = looks.agg(F.max(F.greatest(*[F.size(c) for c in SETS])).alias("n")).first()["n"] or 0
    numbers = [F.transform(c, lambda t: F.xxhash64(t)).alias(c) for c in SETS]  # in place of texts, as are the keys
    sides = [F.col("source_id"), F.col("class"), F.struct(*numbers, "severity").alias("s"), *[F.col(f"by_{c}") for c in SETS]]
    least = cfg.min_similarity - HALF_DIGIT
    asked = looks.where("asked").join(bars.withColumnRenamed("q", "class"), ["source_id", "class"], "left").select(
        *sides, F.greatest(F.coalesce(F.col("bar"), F.lit(0.0)) - HALF_DIGIT, F.lit(least)).alias("need"))
    old = looks.where("archived").select(*sides)

    def keys(level: float, asking: bool) -> Column:
        """Every look over a level's similarity has one of these keys in common with the asked one."""
        ends = lambda part: _prefix_keys(F.col(f"by_{part}"), _least_share(part, level), longest, asking)
        mark = F.concat_ws("\u0001", F.lit(str(level)), F.col("severity")) if level >= 0.9 else F.lit(str(level))
        one = F.transform(ends("services" if level >= 0.9 else "templates"), lambda x: F.concat_ws("\u0001", mark, x))
        if level < 0.75:
            return one
        words = ends("cause_tokens")
        return F.flatten(F.transform(one, lambda x: F.transform(words, lambda w: F.concat_ws("\u0001", x, w))))

    # below the levels any one part must agree by itself: the best of four weighted means is no less than the mean
    alone = (least - WEIGHTS["severity"]) / (1 - WEIGHTS["severity"])

    def alone_keys(asking: bool) -> Column:
        marked = lambda c: F.transform(_prefix_keys(F.col(f"by_{c}"), alone, longest, asking), lambda x: F.concat_ws("\u0001", F.lit(c), x))
        return F.concat(*[marked(c) for c in SETS])

    severity = lambda df: df.withColumn("severity", F.col("s.severity"))
    chosen = alone_keys(True)
    for level in LEVELS:
        chosen = F.when(F.col("need") > level, keys(level, True)).otherwise(chosen)
    a = severity(asked).withColumn("keys", F.array_distinct(chosen)).select("source_id", F.col("class").alias("q"), F.col("s").alias("qs"), "need", "keys")
    b = severity(old).withColumn("keys", F.array_distinct(F.concat(alone_keys(False), *[keys(level, False) for level in LEVELS])))
    b = b.select("source_id", F.col("class").alias("p"), F.col("s").alias("ps"), "keys")
    # a list of a common term is split into parts, and who asks for it asks every part; few bytes make many comparisons here
    listed = lambda df, part: df.withColumn("key", F.explode("keys")).select(
        *[c for c in df.columns if c != "keys"], F.xxhash64("key").alias("key"), part.alias("part")).repartition(LIST_PARTS, "source_id", "key", "part")
    asks = listed(a, F.explode(F.array(*[F.lit(i) for i in range(LIST_PARTS)])))
    lists = listed(b, F.pmod("p", F.lit(LIST_PARTS)).cast("int"))
    met = with_similarity(asks.join(lists, ["source_id", "key", "part"]), "qs", "ps", "need")
    return scan.computed_once(met).where(F.col("similarity") >= F.col("need")).select("source_id", "q", "p", "similarity").distinct()


def similar_incidents(
    queries: DataFrame, archive: DataFrame, top: int = 3, cfg: Config = DEFAULT
) -> DataFrame:
    """M3: the best precedents of each incident, out of the whole archive of its source.

    Incidents that look the same are compared once: both sides are reduced to distinct looks, an archived look keeping its
    newest ``top + 1`` incidents (one may be the asked one itself; older ones can only tie). The search is a threshold join. Shelves of
    nearly equal looks first give every asked look a bar that its answers reach. What reaches the bar must agree on
    templates, over 0.75 on words of the cause too, and over 0.9 on severity and services, by shares that follow from the weights; looks are
    therefore met by the rare ends of their term lists alone, so terms that nearly all share form no pairs. Looks without a bar above
    0.65 are met by any one part that agrees well enough by itself. The least similarity must be above 0.1.
    """
    parts = [*SETS, "severity"]
    coded = lambda df: df.withColumn("class", F.xxhash64(*parts))
    asked, old = scan.durable(coded(queries)), scan.durable(coded(archive))
    entry = F.struct("opened_at", "incident_no", "cause", "outcome")
    newest = Window.partitionBy("source_id", "class").orderBy(F.desc("opened_at"), F.desc("incident_no"))
    members = old.withColumn("__r", F.row_number().over(newest)).where(F.col("__r") <= top + 1).groupBy("source_id", F.col("class").alias("p")).agg(
        F.collect_list(entry).alias("members"))
    looks = scan.durable(_looks(asked, old))
    pairs = _candidates(looks, _bars(looks, old, top, cfg), cfg)
    scored = pairs.join(members, ["source_id", "p"]).select("source_id", "q", "similarity", F.explode("members").alias("m"))
    scored = scored.where(F.round("similarity", 3) >= cfg.min_similarity)
    order = [F.round("similarity", 3).desc(), F.col("m.opened_at").desc(), F.col("m.incident_no").desc()]
    best = Window.partitionBy("source_id", "q").orderBy(*order)
    per_look = scored.withColumn("__r", F.row_number().over(best)).where(F.col("__r") <= top + 1)
    own = Window.partitionBy("source_id", "incident_no", "opened_at").orderBy(*order)
    return (
        asked.select("source_id", F.col("class").alias("q"), "incident_no", "opened_at").join(per_look, ["source_id", "q"])
        .where(~((F.col("incident_no") == F.col("m.incident_no")) & (F.col("opened_at") == F.col("m.opened_at"))))
        .withColumn("rank", F.row_number().over(own))
        .where(F.col("rank") <= top)
        .select(
            "source_id", "incident_no", F.col("m.incident_no").alias("precedent_no"),
            F.col("m.opened_at").alias("precedent_opened_at"), "similarity", "rank",
            F.col("m.cause").alias("cause"), F.coalesce("m.outcome", F.lit("not recorded")).alias("outcome"),
        )
    )


def record_outcome(archive: DataFrame, labels: DataFrame) -> DataFrame:
    """M4: outcomes by full key (source_id, incident_no, opened_at)."""
    key = ["source_id", "incident_no", "opened_at"]
    given = labels.where(F.col("outcome").isin(*OUTCOMES)).select(
        *key, F.col("outcome").alias("__o"), F.col("outcome_note").alias("__n")
    )
    return (
        archive.join(given, key, "left")
        .withColumns({
            "outcome": F.coalesce("__o", "outcome"),
            "outcome_note": F.when(F.col("__o").isNotNull(), F.col("__n")).otherwise(F.col("outcome_note")),
        })
        .drop("__o", "__n")
    )


def accuracy(archive: DataFrame) -> DataFrame:
    """Share of judged incidents whose fix worked; unlabelled ones are not misses."""
    is_ = lambda o: F.count_if(F.col("outcome") == o)
    judged = F.count_if(F.col("outcome").isin(*OUTCOMES))
    return archive.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("incidents"),
        judged.alias("judged"),
        (F.count(F.lit(1)) - judged).alias("unknown"),
        is_("worked").alias("right"),
        is_("did_not_work").alias("fix_did_not_work"),
        is_("wrong_diagnosis").alias("wrong_diagnosis"),
        F.count_if(F.col("outcome").isin(*OUTCOMES) & F.col("outcome_note").contains("auto-verified")).alias("auto_verified"),
        F.when(judged > 0, is_("worked") / judged).alias("rate"),
    )


def recurring_patterns(archive: DataFrame, min_count: int = 2) -> DataFrame:
    """Templates and detectors that appear in several archived incidents."""
    kinds = [
        archive.select("source_id", F.lit(kind).alias("kind"), F.explode(column).alias("value"))
        for kind, column in (("template", "templates"), ("detector", "detectors"))
    ]
    return (
        kinds[0].unionByName(kinds[1])
        .groupBy("source_id", "kind", "value")
        .agg(F.count(F.lit(1)).alias("n_incidents"))
        .where(F.col("n_incidents") >= min_count)
    )


def search_history(archive: DataFrame, words: str, top: int = 5) -> DataFrame:
    """M9: archived incidents by the number of query words in their cause; top five."""
    text = F.lower(F.concat_ws(" ", "cause", *[c for c in ("hypothesis",) if c in archive.columns]))
    wanted = sorted({w.lower() for w in words.split() if len(w) > 2})
    score = sum((text.contains(w).cast("long") for w in wanted), F.lit(0).cast("long"))
    return (
        archive.withColumn("score", score)
        .where("score > 0")
        .orderBy(F.desc("score"), "source_id", "incident_no")
        .limit(top)
    )
