"""Report tables: reads by key, records, sightings, imports, provenance and the status of a report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.functions.decide import MEASURED, allowed_or, entry_mode, finite_or_null
from wayline.functions.dates import epoch_seconds

#: What a reader of drives, and an import, take where a field is missing.
DEFAULTS = {"assessment": "clear", "image_quality": "usable", "damage_type": "pothole_cavity", "temporal_consistency": "consistent"}
#: Fixed value: most characters of a source key.
KEY_LENGTH = 180
#: Statuses from which each action is allowed, and the status it leads to (None: as it was).
ACTIONS = {
    "open": (("draft", "queued"), "queued"),
    "submit": (("draft", "queued", "sent"), "sent"),
    "edit": (("draft", "queued"), None),
    "delete": (("draft", "queued", "unrouted", "review", "rejected"), "deleted"),
}
LEAST_REFERENCE = 4


def listing(reports: DataFrame, limit: int | None = None) -> DataFrame:
    """Reports newest first, without the heavy photo, the light one named photo_url; the first `limit` only if given."""
    light = reports.drop("photo_full").withColumnRenamed("photo", "photo_url").orderBy(F.desc("id"))
    return light if limit is None else light.limit(limit)


def by_key(table: DataFrame, key: str, value: object) -> DataFrame:
    """The row of a key; the filter reaches the files' statistics."""
    return table.where(F.col(key) == F.lit(value))


def of_drive(table: DataFrame, drive_id: str, order: Sequence[Column]) -> DataFrame:
    """The rows of one drive in order."""
    return table.where(F.col("drive_id") == drive_id).orderBy(*order)


def sighted_on(reports: DataFrame, drive_id: str) -> DataFrame:
    """Reports with a sighting of the drive."""
    return reports.where(F.array_contains("sighting_drive_ids", drive_id))


def latitude_band(reports: DataFrame, lat: float, metres: float = 8.0) -> DataFrame:
    """Reports within `metres` of a parallel. Stored in the order of their latitude, only the files of the band are read."""
    reach = metres / 110_900
    return reports.where(F.col("lat").between(lat - reach, lat + reach))


def clean_sighting() -> Column:
    """The sighting of a report: its measured fields, each null unless finite."""
    drive = F.col("drive_id").cast("string").alias("drive_id")
    return F.struct(drive, *[finite_or_null(F.col(c)).alias(c) for c in MEASURED], F.nullif("source_event_key", F.lit("")).alias("source_event_key"))


def imported(native: DataFrame) -> DataFrame:
    """Reports of a device under the names and defaults of the store; those without a sound id or position are left out."""
    id_, lat, lng = F.col("id").cast("long"), finite_or_null(F.col("lat").cast("double")), finite_or_null(F.col("lng").cast("double"))
    sound = native.where((id_ > 0) & (F.abs(lat) <= 90) & (F.abs(lng) <= 180))
    key = F.coalesce(F.nullif("source_event_key", F.lit("")), F.concat(F.lit("native:"), id_.cast("string")))
    shown = F.format_string("%.5f, %.5f", lat, lng)
    return sound.select(
        id_.alias("native_id"),
        F.substring(key, 1, KEY_LENGTH).alias("source_event_key"),
        lat.alias("lat"),
        lng.alias("lng"),
        F.coalesce(F.nullif("address", F.lit("")), shown).alias("address"),
        F.coalesce(F.col("is_reportable"), F.lit(0)).cast("int").alias("is_reportable"),
        *[F.coalesce(F.nullif(c, F.lit("")), F.lit(default)).alias(c) for c, default in DEFAULTS.items()],
        (F.coalesce(F.nullif("damage_type", F.lit("")), F.lit(DEFAULTS["damage_type"])) == "pothole_cavity").cast("int").alias("is_pothole"),
        epoch_seconds(F.col("captured_ms")).alias("captured_at"),
        entry_mode(F.col("mode"), F.col("source")).alias("entry_mode"),
        allowed_or(F.col("size"), ("small", "medium", "large"), "unknown").alias("size"),
    )


def records(reports: DataFrame, routed: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Reports with their route's columns, all of these null unless the route is covered."""
    told = [F.when(F.coalesce("covered", F.lit(False)), F.col(f"_r.{c}")).alias(c) for c in columns]
    joined = reports.join(routed.select(F.col(key).alias("_key"), "covered", F.struct(*columns).alias("_r")), F.col(key) == F.col("_key"), "left")
    return joined.select(*[reports[c] for c in reports.columns], F.coalesce("covered", F.lit(False)).alias("covered"), *told)


def provenance(reports: DataFrame, packs: DataFrame, pack: str, prefix: str = "routing") -> DataFrame:
    """Reports with id, version, digest and state of the pack that their column `pack` names; nulls for an unknown one."""
    fields = {"pack_id": "pack_id", "pack_version": "pack_version", "pack_sha256": "sha256", "pack_state_code": "state_code"}
    known = packs.select(F.col("pack_id").alias("_pack"), *[F.col(c).alias(f"{prefix}_{name}") for name, c in fields.items()])
    return reports.join(known, F.col(pack) == F.col("_pack"), "left").drop("_pack")


def geocoded(reports: DataFrame, addresses: DataFrame, places: int = 4) -> DataFrame:
    """Reports with the cached address of their grid point of about 11 metres; null where none is cached."""
    at = lambda c: F.round(F.col(c) * 10**places).cast("long")
    cache = addresses.groupBy(at("lat").alias("_y"), at("lng").alias("_x")).agg(F.min_by("address", "ordinal").alias("address"))
    return reports.join(cache, (at("lat") == F.col("_y")) & (at("lng") == F.col("_x")), "left").drop("_y", "_x")


def foreign_digests(reports: DataFrame, manifest: DataFrame) -> DataFrame:
    """Saved reports whose pack digest belongs to another pack of the manifest now."""
    owners = manifest.groupBy(F.col("sha256").alias("_sha")).agg(F.min("pack_id").alias("owner"))
    return reports.join(owners, F.col("routing_pack_sha256") == F.col("_sha")).where(F.col("owner") != F.col("routing_pack_id")).drop("_sha")


def transition(status: Column, action: Column, reference: Column, reference_required: Column) -> Column:
    """The status after an action, null where it is refused. Submitting may need the office's own reference."""
    after = F.lit(None).cast("string")
    for name, (allowed, to) in ACTIONS.items():
        ok = (action == name) & status.isin(*allowed)
        if name == "submit":
            short = F.length(F.substring(F.trim(F.coalesce(reference, F.lit(""))), 1, 100)) < LEAST_REFERENCE
            ok = ok & ~(F.coalesce(reference_required, F.lit(False)) & short)
        after = F.when(ok, F.lit(to) if to else status).otherwise(after)
    return after


def in_commit_order(done: DataFrame) -> DataFrame:
    """When each report can be stored: captures of one drive are stored in their order, so each waits for all before it.

    `done` has drive_id, seq (order of capture) and ready_at; reports of no drive wait for none.
    """
    before = Window.partitionBy("drive_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return done.withColumn("commit_at", F.when(F.col("drive_id").isNull(), F.col("ready_at")).otherwise(F.max("ready_at").over(before)))


def capture_gaps(captures: DataFrame) -> DataFrame:
    """Captures, span in seconds, mean spacing and longest gap of each drive."""
    gap = F.col("ts") - F.lag("ts").over(Window.partitionBy("drive_id").orderBy("ts", "seq"))
    span = F.max("ts") - F.min("ts")
    return captures.withColumn("gap", gap).groupBy("drive_id").agg(F.count("*").alias("captures"), span.alias("span"), F.when(F.count("*") > 1, span / (F.count("*") - 1)).alias("spacing"), F.max("gap").alias("longest"))


def without_repeats(*tables: DataFrame, key: str = "id") -> DataFrame:
    """The rows of several tables, each key once: that of the first table that has it."""
    marked = [t.withColumn("_from", F.lit(i)) for i, t in enumerate(tables)]
    every = marked[0]
    for t in marked[1:]:
        every = every.unionByName(t)
    turn = F.row_number().over(Window.partitionBy(key).orderBy("_from"))
    return every.withColumn("_turn", turn).where("_turn = 1").drop("_turn", "_from")


def same_members(a: Column, b: Column) -> Column:
    """Whether two arrays have the same distinct members."""
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def capped(items: Column, most: int) -> Column:
    """The first `most` members of an array."""
    return F.slice(items, 1, most)


#: What a record keeps of its route and of its contract, under these names; all null unless the route is covered.
ROUTE_FIELDS = (
    "officer_name", "officer_email", "authority_id", "authority_name", "authority_registry_version", "ward_code", "routing_source", "routing_match_field", "routing_match_value", "highway_ref",
    "routing_pack_id", "routing_pack_version", "routing_pack_sha256", "routing_pack_state_code", "region", "handoff_name", "handoff_url", "handoff_package", "alternate_handoff_name",
    "alternate_handoff_url", "whatsapp_url", "helpline",
)
TENDER_FIELDS = ("tender_number", "contractor", "tender_note", "tender_pack_id", "tender_pack_version", "tender_pack_sha256", "tender_pack_state_code")
#: What a record says where the device said nothing; versions and models come from the caller.
RECORD_DEFAULTS = DEFAULTS | {"description": "Reportable road damage detected during Drive Mode.", "decision": "accept"}
CHECKS = ("on_drivable_surface", "has_broken_edge_or_rim", "has_depth_or_surface_loss")


def drive_records(native: DataFrame, routes: DataFrame, contracts: DataFrame, settings: dict[str, str | int], now_s: Column) -> DataFrame:
    """The store's record of every sound report of a device: what was seen, who it is routed to, and its first sighting.

    `native` has the device's columns, `routes` (id, routed, unrouted_reason, tender_eligible, delivery_channel, ownership_unverified,
    requires_official_reference and ROUTE_FIELDS) and `contracts` (id and TENDER_FIELDS) at most a row for each id. `settings` has detection_model,
    image_detail, prompt_version and schema_version for rows without their own. A report without a covered route is
    unrouted, with a reason and the body's name; a contract counts only if the route is eligible. Photos stay where they are, and letters are written by others.
    """
    number = lambda c: finite_or_null(F.col(c).cast("double"))
    text = lambda c, default: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(default))
    whole = lambda c, default: F.coalesce(F.nullif(F.col(c).cast("long"), F.lit(0)), F.lit(default)).cast("long")
    id_, lat, lng = F.col("id").cast("long"), number("lat"), number("lng")
    key = F.substring(F.coalesce(F.nullif("source_event_key", F.lit("")), F.concat(F.lit("native:"), id_.cast("string"))), 1, KEY_LENGTH)
    sound = native.where((id_ > 0) & (F.abs(lat) <= 90) & (F.abs(lng) <= 180))
    debug, drive = F.coalesce("debug_capture", F.lit(False)), F.col("drive_id").cast("string")
    own = sound.select(
        id_.alias("native_id"), F.coalesce(F.nullif(number("created_at"), F.lit(0.0)), now_s).alias("created_at"), lat.alias("lat"), lng.alias("lng"),
        F.coalesce(F.nullif("address", F.lit("")), F.format_string("%.5f, %.5f", lat, lng)).alias("address"), F.coalesce(F.col("is_reportable").cast("int") == 1, F.lit(False)).cast("int").alias("is_reportable"),
        *[text(c, default).alias(c) for c, default in RECORD_DEFAULTS.items()], *[F.coalesce(F.col(c), F.lit(True)).alias(c) for c in CHECKS],
        F.nullif("size", F.lit("")).alias("size"), *[text(c, settings[c]).alias(c) for c in ("detection_model", "image_detail", "prompt_version")],
        whole("schema_version", settings["schema_version"]).alias("schema_version"), whole("evidence_count", 1).alias("evidence_count"), F.coalesce(F.col("primary_frame_index").cast("long"), F.lit(0)).alias("primary_frame_index"),
        drive.alias("drive_id"), F.lit("drive_live").alias("capture_source"), key.alias("source_event_key"), F.array(key).alias("source_event_keys"),
        *[number(c).alias(c) for c in ("captured_at", "source_offset_s", "gps_accuracy", "speed_mps")], ((number("heading") % 360 + 360) % 360).alias("heading"),
        debug.alias("debug_capture"), (~debug).alias("dedupe_eligible"), F.when(drive.isNotNull(), F.array(drive)).otherwise(F.array().cast("array<string>")).alias("sighting_drive_ids"),
        F.lit(1).alias("seen_count"), F.coalesce(number("captured_at"), now_s).alias("last_seen_at"),
        F.array(F.struct(drive.alias("drive_id"), *[number(c).alias(c) for c in MEASURED], key.alias("source_event_key"))).alias("event_sightings"),
    )
    own = own.withColumn("is_pothole", (F.col("damage_type") == "pothole_cavity").cast("int"))
    joined = own.join(routes.select(F.col("id").alias("_id"), F.struct("*").alias("_r")), F.col("native_id") == F.col("_id"), "left").drop("_id")
    joined = joined.join(contracts.select(F.col("id").alias("_id"), F.struct("*").alias("_c")), F.col("native_id") == F.col("_id"), "left").drop("_id")
    covered = F.coalesce(F.col("_r.routed"), F.lit(False))
    eligible = covered & F.coalesce(F.col("_r.tender_eligible"), F.lit(False))
    given = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    return joined.select(
        *own.columns, F.when(covered, "draft").otherwise("unrouted").alias("status"), F.when(~covered, F.coalesce(given("_r.unrouted_reason"), F.lit("outside_area"))).alias("unrouted_reason"),
        F.when(~covered, given("_r.authority_name")).alias("unrouted_body"), *[F.when(covered, given(f"_r.{c}")).alias(c) for c in ROUTE_FIELDS],
        F.when(covered, F.coalesce(given("_r.delivery_channel"), F.lit("email"))).alias("delivery_channel"), F.when(covered, F.coalesce("_r.ownership_unverified", F.lit(False))).alias("ownership_unverified"),
        (covered & F.coalesce("_r.requires_official_reference", F.lit(False))).alias("requires_official_reference"), *[F.when(eligible, given(f"_c.{c}")).alias(c) for c in TENDER_FIELDS],
        *[F.lit(None).cast(kind).alias(c) for c, kind in (("official_grievance_id", "string"), ("submitted_at", "double"), ("sent_at", "double"))],
    )
