"""Contracts: pools by body, ranked shortlists, and places resolved to bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.functions.dates import sort_stamp
from wayline.functions.geo import bound
from wayline.functions.text import about_road_work, address_tokens, body_name, inverse_frequency, place_key, similarity

#: The bodies that share one older pool of contracts, and that pool's name.
POOLED_BODIES = ("305850", "305851", "305852", "305853", "305854")
OLD_POOL = "BLR"


def notice_bodies(notices: DataFrame, places: DataFrame, bodies: DataFrame) -> DataFrame:
    """The columns of notices (tn, loc, ...), with `b`, the body's code, and `outcome`, why there is none.

    Of notices of the two agencies, those of the city's own are `pooled` under OLD_POOL; others are `mapped` to the code that
    `places` (location, lgd) gives their location, if `bodies` (lgd, email) has an address for it, else `no_address`; a
    location without a code is `unresolved`, and any other agency's notice `other_agency`. Both lists have a row for each key.
    """
    agency = F.upper(F.get(F.split(F.coalesce("tn", F.lit("")), "/"), F.lit(0)))
    known = places.select(F.trim("location").alias("_loc"), F.col("lgd").cast("string").alias("_code"))
    reached = bodies.where(F.coalesce(F.trim("email"), F.lit("")) != "").select(F.col("lgd").cast("string").alias("_code"), F.lit(True).alias("_reached"))
    told = notices.withColumn("_loc", F.trim(F.coalesce("loc", F.lit("")))).join(known, "_loc", "left").join(reached, "_code", "left")
    outcome = (
        F.when(~agency.isin("DMA", "BBMP"), "other_agency").when(agency == "BBMP", "pooled").when(F.col("_code").isNull(), "unresolved")
        .when(F.col("_reached"), "mapped").otherwise("no_address")
    )
    code = F.when(F.col("outcome") == "pooled", F.lit(OLD_POOL)).when(F.col("outcome") == "mapped", F.col("_code"))
    return told.withColumn("outcome", outcome).withColumn("b", code).drop("_loc", "_code", "_reached")


def in_locale(text: Column) -> Column:
    """A text as it sorts for readers: letters before case and accents, by the root collation of Unicode; bytes decide equals."""
    return F.collate(text, "UNICODE")


def road_works(notices: DataFrame) -> DataFrame:
    """Notices about roads, the first of each number by `ordinal`."""
    some = notices.where((F.trim("tn") != "") & about_road_work(F.col("title")))
    first = F.row_number().over(Window.partitionBy("tn").orderBy("ordinal"))
    return some.withColumn("_turn", first).where("_turn = 1").drop("_turn")


def shortlist(reports: DataFrame, tenders: DataFrame, most: int = 25) -> DataFrame:
    """The best contracts for each report: by the rarity of shared words, newest first, then by number in the order of readers.

    Reports have (report_id, address, lgd), tenders (tn, b, title, location, published). A body's words in its own
    location say nothing; a word's weight is its inverse frequency in the pool. Scores are summed in the words' order.
    Reports of one body with the same words have the same list, so lists are made once for each such question.
    """
    own = F.when(F.col("lgd").isin(*POOLED_BODIES), F.array("lgd", F.lit(OLD_POOL))).otherwise(F.array("lgd"))
    asked = reports.where("lgd IS NOT NULL").select("report_id", "lgd", address_tokens(F.col("address")).alias("tokens"))
    questions = asked.select("lgd", "tokens").distinct()
    pools = questions.select("lgd").distinct().withColumn("b", F.explode(own))
    pool = pools.join(tenders, "b").select("lgd", "tn", "published", "location", F.col("b") == F.col("lgd"), F.lower(F.coalesce("title", F.lit(""))).alias("hay")).toDF("lgd", "tn", "published", "location", "is_own", "hay")
    about = pool.groupBy("lgd").agg(F.count("*").alias("n"), F.min_by("location", F.struct(~F.col("is_own"), "tn")).alias("place"))
    told = F.filter(F.split(F.lower(F.coalesce("place", F.lit(""))), "[^a-z]+"), lambda w: F.length(w) > 2)
    words = questions.join(about, "lgd").select("lgd", "tokens", "n", F.posexplode(F.array_except("tokens", told)).alias("turn", "token"))
    found = words.select("lgd", "token", "n").distinct().join(pool.select("lgd", "tn", "published", "hay"), "lgd").where(F.contains("hay", F.col("token"))).drop("hay")
    weights = found.groupBy("lgd", "token").agg(F.count("*").alias("df"), F.first("n").alias("n")).withColumn("idf", inverse_frequency(F.col("n"), F.col("df"))).where("idf IS NOT NULL")
    hits = words.join(weights.select("lgd", "token", "idf"), ["lgd", "token"]).join(found.select("lgd", "token", "tn", "published"), ["lgd", "token"])
    summed = F.aggregate(F.sort_array(F.collect_list(F.struct("turn", "idf"))), F.lit(0.0), lambda t, x: t + x["idf"])
    scored = hits.groupBy("lgd", "tokens", "tn").agg(F.round(summed, 6).alias("score"), F.first("published").alias("published"))
    order = Window.partitionBy("lgd", "tokens").orderBy(F.desc("score"), F.desc(sort_stamp(F.col("published"))), in_locale(F.col("tn")), "tn")
    lists = scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("lgd", "tokens", "place", "tn", "score")
    return asked.join(lists, ["lgd", "tokens"]).select("report_id", "place", "tn", "score")


def letter_pairs(key: Column) -> Column:
    """The pairs of neighbouring letters of a text, each with how often it came before, so that shared ones can be counted as a set."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(key) - 1, F.lit(1))), lambda i: F.substring(key, i, F.lit(2)))
    numbered = lambda ps: F.transform(ps, lambda x, i: F.concat(x, F.size(F.filter(F.slice(ps, F.lit(1), i + 1), lambda y: y == x)).cast("string")))
    return F.when(F.length(key) > 1, bound(pairs, numbered)).otherwise(F.array().cast("array<string>"))


def least_shared(a: Column, b: Column, least: float) -> Column:
    """Letter pairs that two texts of these lengths share at least if their ratio is `least`.

    A ratio r has m letters in common blocks, 2m >= r (a + b). Between two blocks stands a letter without a partner, so blocks
    are 1 + (a + b - 2m) at most, and each has a pair less than letters: m - 1 - (a + b - 2m) pairs.
    """
    return 3 * F.ceil(least * (a + b) / 2 - 1e-9) - 1 - (a + b)


def similar_keys(keys: DataFrame, towns: DataFrame, least: float) -> DataFrame:
    """(key, town, ratio): texts `key` with those `town` whose ratio is `least` or more; both distinct.

    An inverted index of letter pairs: of n pairs of a text, of which it must share c, only the n - c + 1 rarest are looked up,
    and kept; two texts that share c have one of these in common. Candidates with too few shared pairs go before any ratio is
    taken. Lengths for which no pair need be shared (under three letters together, or a low `least`) meet by length.
    """
    low, high = least / (2 - least), (2 - least) / least

    def indexed(texts: DataFrame, name: str, df: DataFrame) -> DataFrame:
        n = F.length(name)
        # Fewest shared pairs over all lengths that the other may have.
        others = F.sequence(F.greatest(F.lit(1), F.ceil(n * low - 1e-9)).cast("int"), F.floor(n * high + 1e-9).cast("int"))
        need = F.array_min(F.transform(others, lambda m: least_shared(n, m, least)))
        pairs = texts.select(name, F.length(name).alias("n"), need.alias("need"), F.explode(letter_pairs(F.col(name))).alias("pair")).join(df, "pair", "left")
        rarest = Window.partitionBy(name).orderBy(F.coalesce("df", F.lit(0)), "pair")
        return pairs.withColumn("turn", F.row_number().over(rarest)).where("turn <= n - 1 - greatest(need, 1) + 1").select(name, "pair")

    df = towns.select(F.explode(letter_pairs(F.col("town"))).alias("pair")).groupBy("pair").agg(F.count("*").alias("df"))
    met = indexed(keys, "key", df).join(indexed(towns, "town", df), "pair").select("key", "town").distinct()
    n, m = F.length("key"), F.length("town")
    near = lambda t: t.where((m >= n * low - 1e-9) & (m <= n * high + 1e-9))
    shared = F.size(F.array_intersect(letter_pairs(F.col("key")), letter_pairs(F.col("town"))))
    some = near(met).where(shared >= least_shared(n, m, least))
    sized = lambda t, c: t.select(c, F.length(c).alias(f"{c}_size"))
    lengths = sized(keys, "key").select("key_size").distinct().join(F.broadcast(sized(towns, "town").select("town_size").distinct()), (F.col("town_size") >= F.col("key_size") * low - 1e-9) & (F.col("town_size") <= F.col("key_size") * high + 1e-9))
    free = lengths.where(least_shared(F.col("key_size"), F.col("town_size"), least) < 1)  # pairs of lengths, not of texts
    rest = sized(keys, "key").join(free, "key_size").join(sized(towns, "town"), "town_size").select("key", "town")
    return some.unionByName(rest).distinct().withColumn("ratio", similarity(F.col("key"), F.col("town"))).where(F.col("ratio") >= least)


def resolve_places(locations: DataFrame, towns: DataFrame, least: float = 0.90, margin: float = 0.03) -> DataFrame:
    """The LGD code of each location, or null: by an exact place key, else by the most similar one if it is similar
    enough and clearly ahead. Several towns of one key resolve to none.

    Only distinct keys without an exact match are compared, and only with towns that an index of letter pairs brings together.
    """
    keyed = locations.select("location").distinct().withColumn("key", place_key(body_name(F.col("location"))))
    known = towns.groupBy(place_key(F.col("name")).alias("town")).agg(F.count("*").alias("n"), F.min("lgd").cast("string").alias("lgd")).withColumn("lgd", F.when(F.col("n") == 1, F.col("lgd")))
    exact = keyed.join(known, keyed["key"] == known["town"]).select("location", "lgd", F.lit("exact").alias("how"))
    rest = keyed.join(known, keyed["key"] == known["town"], "left_anti").where("key <> ''")
    near = similar_keys(rest.select("key").distinct(), known.where("town <> ''").select("town"), least).join(known.select("town", "lgd"), "town")
    order = Window.partitionBy("key").orderBy(F.desc("ratio"), F.desc("town"))
    best = near.withColumn("next", F.lead("ratio").over(order)).withColumn("turn", F.row_number().over(order)).where("turn = 1")
    sure = best.where(F.col("next").isNull() | (F.col("ratio") - F.col("next") >= margin)).select("key", "lgd")
    fuzzy = rest.join(sure, "key", "left").select("location", "lgd", F.when(F.col("lgd").isNotNull(), "similar").otherwise("none").alias("how"))
    empty = keyed.where("key = ''").join(known, F.col("key") == F.col("town"), "left_anti").select("location", F.lit(None).cast("string").alias("lgd"), F.lit("none").alias("how"))
    return exact.unionByName(fuzzy).unionByName(empty)
