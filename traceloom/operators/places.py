"""Place resolution against gazetteer tables, place layers of nodes, and enrichment outcomes."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import text as tx

# ---------------------------------------------------------------- fixed values
SPLIT = r"\s*(?:,|;|/|\(|\)|\bin\b|\bnear\b)\s*"
STRIP_WORDS = ("facility", "plant", "factory", "site", "campus", "province", "city", "state")
METHOD = "gazetteer_v1"
INSTRUMENTS = {"tin": "inst_fixture_lme_sn", "copper": "inst_fixture_lme_cu"}
# ---------------------------------------------------------------- end of fixed values

PLACE = "struct<country_iso2:string,admin1:string,city:string,lat:double,lon:double,precision:string>"


def place_names(countries, regions, cities, key=tx.native_label_key) -> DataFrame:
    """One name table from the three gazetteer tables, each with `aliases` and `pos`.

    A name keeps its first entry per country, so it never has more rows than there are countries.
    """

    def names(df, kind, country, admin1, city):
        all_names = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
        return df.withColumn("__name", F.explode(all_names)).select(
            F.lit(kind).alias("type"),
            key(F.col("__name")).alias("name_key"),
            F.col("pos").cast("long").alias("pos"),
            country.alias("country"),
            admin1.cast("string").alias("admin1"),
            city.cast("string").alias("city"),
            "lat",
            "lon",
        )

    none = F.lit(None)
    table = (
        names(countries, "country", F.col("code"), none, none)
        .union(names(regions, "region", F.col("country"), F.col("name"), none))
        .union(names(cities, "city", F.col("country"), F.nullif("admin1", F.lit("")), F.col("name")))
    )
    entry = F.struct("pos", "country", "admin1", "city", "lat", "lon")
    return table.groupBy("type", "name_key", F.col("country").alias("entry_country")).agg(
        F.min(entry).alias("entry")
    )


def label_phrases(labels: DataFrame, key=tx.native_label_key) -> DataFrame:
    """Candidate place names of each (label, hint): its parts, each with all word tails and then
    all word heads, with their order."""
    parts = labels.select("label", "hint", F.posexplode(F.split("label", SPLIT)).alias("part", "text"))
    text = key(F.col("text"))
    for word in STRIP_WORDS:
        text = F.regexp_replace(text, rf"\b{word}\b", "")
    parts = parts.withColumn("words", F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    count = F.size("words")
    run = lambda start, size: F.array_join(F.slice("words", start, size), " ")
    tails = F.transform(F.sequence(F.lit(1), count), lambda i: run(i, count - i + 1))
    heads = F.when(
        count > 1, F.transform(F.sequence(count - 1, F.lit(1)), lambda n: run(F.lit(1), n))
    ).otherwise(F.array().cast("array<string>"))
    return parts.where(count > 0).select(
        "label", "hint", "part", F.posexplode(F.concat(tails, heads)).alias("phrase", "name_key")
    )


def resolve_places(labels: DataFrame, countries, regions, cities, key=tx.native_label_key) -> DataFrame:
    """Best place of each distinct (label, hint): a city, else a region, that agrees with the
    country hinted, named in the label or implied by a named region; else the country's centre."""
    asked = labels.select("label", "hint").distinct()
    names = place_names(countries, regions, cities, key)
    hits = label_phrases(asked, key).join(names, "name_key")
    order = F.struct("part", "phrase", F.col("entry.pos").alias("pos"))
    of = lambda kind: F.when(F.col("type") == kind, order)
    implied = hits.groupBy("label", "hint").agg(
        F.min_by("entry_country", of("country")).alias("named"),
        F.min_by("entry_country", of("region")).alias("by_region"),
    )
    codes = countries.select(
        F.col("code").alias("hint_code"),
        F.concat(F.array(F.lower("code")), F.transform(
            F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), key
        )).alias("forms"),
    )
    codes = codes.select("hint_code", F.posexplode("forms").alias("form_pos", "hint_key"))
    codes = codes.groupBy("hint_key").agg(
        F.min_by("hint_code", F.struct((F.col("form_pos") > 0).alias("n"), "hint_code")).alias("hint_code")
    )
    match = lambda c: F.col(c).eqNullSafe(F.col(f"r_{c}"))

    def keyed(df):
        return df.withColumnRenamed("label", "r_label").withColumnRenamed("hint", "r_hint")

    countried = (
        asked.join(keyed(implied), match("label") & match("hint"), "left")
        .drop("r_label", "r_hint")
        .withColumn("hint_key", key(F.col("hint")))
        .join(codes, "hint_key", "left")
        .select("label", "hint", F.coalesce("hint_code", "named", "by_region").alias("country"))
    )
    agreed = hits.join(keyed(countried), match("label") & match("hint")).where(
        F.col("country").isNull() | (F.col("entry_country") == F.col("country"))
    )
    place = lambda precision: F.struct(
        F.col("entry_country").alias("country_iso2"),
        F.col("entry.admin1").alias("admin1"),
        F.col("entry.city").alias("city"),
        F.col("entry.lat").cast("double").alias("lat"),
        F.col("entry.lon").cast("double").alias("lon"),
        F.lit(precision).alias("precision"),
    )
    best = agreed.groupBy("label", "hint").agg(
        F.min_by(place("city"), of("city")).alias("c"), F.min_by(place("region"), of("region")).alias("r")
    )
    centre = countries.select(
        F.col("code").alias("country"),
        F.struct(
            F.col("code").alias("country_iso2"),
            F.lit(None).cast("string").alias("admin1"),
            F.lit(None).cast("string").alias("city"),
            F.col("lat").cast("double").alias("lat"),
            F.col("lon").cast("double").alias("lon"),
            F.lit("country").alias("precision"),
        ).alias("k"),
    )
    return (
        countried.join(keyed(best), match("label") & match("hint"), "left")
        .join(centre, "country", "left")
        .select("label", "hint", F.coalesce("c", "r", "k").cast(PLACE).alias("place"))
        .select("label", "hint", "place.*")
    )


# ---------------------------------------------------------------- layers
def evidenced_locations(nodes: DataFrame, claims: DataFrame) -> DataFrame:
    """Accepted location claims that back a node's own place layer.

    `nodes` has id, kind, country_iso2 (of the layer) and iso2 (of a geography node); `claims` are
    the claims the layer lists, with evidence counted in `evidence`.
    """
    layers = nodes.where("country_iso2 is not null").select(F.col("id").alias("subject_id"), "country_iso2")
    places = nodes.where("kind = 'geography' and iso2 is not null").select(
        F.col("id").alias("object_id"), F.col("iso2").alias("country_iso2")
    )
    valid = claims.where("predicate = 'LOCATED_IN' and status = 'accepted' and evidence > 0")
    return valid.join(layers, "subject_id").join(places, ["object_id", "country_iso2"]).select(
        F.col("subject_id").alias("node_id"), "claim_id", "support_label", "country_iso2"
    )


def unlocated_facilities(nodes, evidenced, limit=None) -> DataFrame:
    """Facilities with no evidenced location, the follow-up list; the first `limit` if given."""
    rows = nodes.where("kind = 'facility'").select("id")
    left = rows.join(evidenced.select(F.col("node_id").alias("id")), "id", "left_anti")
    return left.orderBy("id").limit(limit) if limit else left


def same_place(places: DataFrame, geography: DataFrame) -> DataFrame:
    """Resolved places that an existing geography node already stands for."""
    known = geography.select(
        F.col("id").alias("node_id"),
        *[F.col(c).alias(f"g_{c}") for c in ("country_iso2", "precision", "city", "admin1")],
    ).withColumn("g_city", F.nullif("g_city", F.lit(""))).withColumn("g_admin1", F.nullif("g_admin1", F.lit("")))
    folded = known.groupBy("g_country_iso2", "g_precision", "g_city", "g_admin1").agg(F.min("node_id").alias("node_id"))
    condition = (
        (places.country_iso2 == folded.g_country_iso2)
        & (places.precision == folded.g_precision)
        & places.city.eqNullSafe(folded.g_city)
        & places.admin1.eqNullSafe(folded.g_admin1)
    )
    return places.join(folded, condition).select(places["*"], "node_id")


def inherit_places(subjects: DataFrame, located: DataFrame) -> DataFrame:
    """Facilities and organizations with the most precise place their location claims give.

    `located` has subject_id, claim_id, ord and the place layer (country_iso2, admin1, city, lat,
    lon, precision). A layer of its own wins ties; further claims of the same country are counted
    as its evidence.
    """
    rank = model.lookup(F.col("precision"), model.PRECISION_RANK, 0)
    own = subjects.where("country_iso2 is not null").select(
        F.col("id").alias("subject_id"), F.lit(None).cast("string").alias("claim_id"), F.lit(-1).cast("long").alias("ord"),
        "country_iso2", "admin1", "city", "lat", "lon", "precision",
    )
    offered = located.select(*own.columns)
    layers = own.unionByName(offered).withColumn("rank", rank)
    best = layers.groupBy("subject_id").agg(
        F.min_by(F.struct("claim_id", "ord", "country_iso2", "admin1", "city", "lat", "lon", "precision"), F.struct((-F.col("rank")).alias("r"), "ord")).alias("p")
    )
    # claims of the same country recorded after the layer was set extend its evidence
    backing = offered.join(best, "subject_id").where(
        (F.col("ord") > F.col("p.ord")) & (offered.country_iso2 == F.col("p.country_iso2"))
    )
    backing = backing.groupBy("subject_id").agg(F.count_distinct("claim_id").alias("later"))
    able = subjects.where(F.col("kind").isin("facility", "organization")).select("id")
    return (
        best.join(able, best.subject_id == able.id, "left_semi")
        .join(backing, "subject_id", "left")
        .select("subject_id", "p.*", F.coalesce("later", F.lit(0)).alias("later_claims"))
    )


def fill_coordinates(layers: DataFrame, countries, regions, cities, key=tx.native_label_key) -> DataFrame:
    """Centres for located layers without coordinates, same country only, nothing overwritten.

    `layers` has id, label, address, country_iso2, admin1, lat, lon, precision.
    """
    rows = layers.withColumn("__label", F.coalesce(F.nullif("address", F.lit("")), "label"))
    missing = rows.where("lat is null and country_iso2 is not null")
    found = resolve_places(
        missing.select(F.col("__label").alias("label"), F.col("country_iso2").alias("hint")),
        countries, regions, cities, key,
    ).select(
        F.col("label").alias("__label"),
        F.col("hint").alias("__hint"),
        F.struct("country_iso2", "admin1", "lat", "lon", "precision").alias("g"),
    )
    joined = rows.join(
        found,
        (rows["__label"] == found["__label"]) & (rows.country_iso2 == found["__hint"]) & rows.lat.isNull(),
        "left",
    ).drop(found["__label"])
    fits = F.col("g.country_iso2") == F.col("country_iso2")
    return joined.select(
        "id",
        "label",
        "address",
        "country_iso2",
        F.when(fits, F.coalesce("admin1", "g.admin1")).otherwise(F.col("admin1")).alias("admin1"),
        F.when(fits, F.col("g.lat")).otherwise(F.col("lat")).alias("lat"),
        F.when(fits, F.col("g.lon")).otherwise(F.col("lon")).alias("lon"),
        F.when(fits, F.col("g.precision")).otherwise(F.col("precision")).alias("precision"),
        F.when(fits, F.lit(METHOD)).alias("geocoding"),
    )


def place_fields(labels: DataFrame, countries, regions, cities, key=tx.native_label_key) -> DataFrame:
    """Identifier and layer of new geography nodes: the gazetteer's place, else the hinted country
    code alone."""
    found = resolve_places(labels, countries, regions, cities, key)
    code = F.coalesce("country_iso2", "hint")
    return found.where(code.isNotNull()).select(
        "label", "hint", code.alias("country_iso2"), "admin1", "city", "lat", "lon",
        F.coalesce("precision", F.lit("country")).alias("precision"),
        F.when(F.col("country_iso2").isNotNull(), METHOD).otherwise("extractor_country_code").alias("method"),
    )


# ---------------------------------------------------------------- enrichment
def enrichment_outcomes(nodes: DataFrame, kinds, production: DataFrame, evidenced: DataFrame, instruments=None) -> DataFrame:
    """Outcome of every requested layer of every node: filled, unresolved or skipped, and why.

    `nodes` has node_id, kind (NULL when the node is gone) and label_key; `production` lists the
    node ids with a dataset, `evidenced` those with an evidenced location.
    """
    rows = nodes.withColumn("layer", F.explode(F.array(*[F.lit(k) for k in kinds])))
    have = production.select("node_id").distinct().withColumn("has_data", F.lit(True))
    place = evidenced.select("node_id").distinct().withColumn("has_place", F.lit(True))
    rows = rows.join(have, "node_id", "left").join(place, "node_id", "left")
    mapped = model.lookup(F.col("label_key"), instruments or INSTRUMENTS)
    gone = F.col("kind").isNull()
    layer = F.col("layer")
    filled = (
        F.when(layer == "concentration", F.col("has_data"))
        .when(layer == "geography", F.col("has_place"))
        .otherwise((F.col("kind") == "material") & mapped.isNotNull())
    )
    skipped = (layer == "concentration") & (F.col("kind") != "material")
    outcome = (
        F.when(gone, "unresolved")
        .when(skipped, "skipped")
        .when(F.coalesce(filled, F.lit(False)), "filled")
        .otherwise("unresolved")
    )
    why = (
        F.when(gone, "node_removed")
        .when(skipped, "not_a_material")
        .when(layer == "concentration", "no_dataset")
        .when(layer == "geography", "no_evidenced_location")
        .otherwise("no_instrument")
    )
    return rows.select("node_id", "layer", outcome.alias("outcome"), why.alias("why")).select(
        "node_id", "layer", "outcome", F.when(F.col("outcome") != "filled", F.col("why")).alias("reason")
    )


def job_status(results: DataFrame, by) -> DataFrame:
    """Partial when any result is unresolved, else completed."""
    return results.groupBy(*by).agg(
        F.when(F.bool_or(F.col("outcome") == "unresolved"), "partial").otherwise("completed").alias("status"),
        F.count("*").alias("results"),
    )
