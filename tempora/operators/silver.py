"""Clean events, administrative lines, failure onsets, installation cycles, episodes, terminal links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BROKEN, DAY, DEFAULT, Config
from ..functions import expr as X
from ..functions.tables import looked_up, stored
from ..sources.journal import Journal
from .canonical import canonical_map


#: Rows of a canonical map that may be broadcast.
MAP_ROWS = 100_000


def clean_events(j: Journal, cfg: Config = DEFAULT, only: DataFrame | None = None) -> DataFrame:
    """One row a journal line, codes normalised, client and place canonical; with `only` (item), the lines of these items.

    The journal is written once: its lines and both canonical maps read it again, and a map of counted size is broadcast.
    """
    raw = j.item_journey()
    if only is not None:
        wanted = only.select(X.normalise_id(F.col("item")).alias("_w")).distinct()
        wanted = wanted.where("_w IS NOT NULL")
        raw = raw.join(wanted, X.identifier(F.col("item_pairing_code"), F.col("host_serial_code"), F.col("journey_id")) == F.col("_w"), "left_semi")
    raw = stored(raw, "journal")
    if only is None:
        j.written = raw

    def to_map(col: str, master: DataFrame, alias) -> DataFrame:
        # written, so that names are cleaned once each and not once a line
        names = stored(raw.select(F.col(col).alias("source")).distinct(), f"{col}-names")
        found = stored(canonical_map(names, master, alias, cfg), f"{col}-map")
        return F.broadcast(found) if found.count() <= MAP_ROWS else found

    clients = to_map("client", j.clients(), cfg.client_alias).select(F.col("source").alias("c_source"), F.col("canonical").alias("client"))
    places = to_map("place", j.places(), cfg.place_alias).select(F.col("source").alias("p_source"), F.col("canonical").alias("place"))
    e = raw.select(
        "journey_id",
        X.clean(F.col("item_category")).alias("category"),
        X.clean(F.col("item_type")).alias("item_type"),
        X.clean(F.col("item_model_code")).alias("model"),
        X.clean(F.col("item_pairing_code")).alias("pairing"),
        X.clean(F.col("host_serial_code")).alias("host"),
        X.identifier(F.col("item_pairing_code"), F.col("host_serial_code"), F.col("journey_id")).alias("item"),
        X.clean(F.col("client")).alias("raw_client"),
        X.clean(F.col("place")).alias("raw_place"),
        X.clean(F.col("wo_type")).alias("wo_type"),
        X.clean(F.col("wo_code")).alias("wo_code"),
        X.clean(F.col("activity")).alias("activity"),
        X.clean(F.col("status")).alias("status"),
        X.clean(F.col("done_by")).alias("done_by"),
        F.upper(F.coalesce("remark", F.lit(""))).alias("remark"),
        "created_us",
    )
    e = e.join(clients, F.col("raw_client") == F.col("c_source"), "left").join(places, F.col("raw_place") == F.col("p_source"), "left")
    return e.drop("c_source", "p_source", "raw_client", "raw_place")


def work_order_types(j: Journal) -> DataFrame:
    """(w_code, order_type): the type by code or by name of each code's latest order; ties go to the first type code."""
    types = j.work_type().select(X.clean(F.col("work_type_code")).alias("t_code"), X.clean(F.col("work_type")).alias("t_name"))
    keys = types.select(F.explode(F.array_distinct(F.array("t_code", "t_name"))).alias("key"), "t_code", "t_name").where("key IS NOT NULL")
    orders = j.work_order().select(X.clean(F.col("wo_code")).alias("w_code"), "wo_id", X.clean(F.col("work_type_code")).alias("o_type")).where("w_code IS NOT NULL")
    both = orders.join(keys, F.col("o_type") == F.col("key"), "left")
    return both.groupBy("w_code").agg(F.min_by(F.coalesce("t_name", "o_type"), F.struct(-F.col("wo_id"), F.coalesce("t_code", F.lit("")))).alias("order_type"))


def _after(cond: Column, w: Window) -> Column:
    """First (time, id) after the row where cond holds: the last one seen in descending order, which needs one pass only."""
    return F.last(F.when(cond, F.struct("created_us", "journey_id")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))


def with_onsets(events: DataFrame) -> DataFrame:
    """events with is_onset: corrective dismantling, or a preventive one that is found broken before the next install.

    Onsets come from all events, administrative ones too; an event without time never follows another.
    """
    w = Window.partitionBy("item", F.col("created_us").isNull()).orderBy(F.desc("created_us"), F.desc("journey_id"))
    timed = F.col("created_us").isNotNull()
    out = events.withColumn("_broken", _after(F.col("status").isin(*BROKEN), w)).withColumn("_install", _after(F.col("status") == "INSTALLED", w))
    preventive = timed & F.col("_broken").isNotNull() & (F.col("_install").isNull() | (F.col("_broken") < F.col("_install")))
    dismantled = F.coalesce(F.col("status") == "DISMANTLED", F.lit(False))
    onset = dismantled & (F.coalesce(F.col("wo_type") == "CORRECTIVE", F.lit(False)) | (F.coalesce(F.col("wo_type") == "PREVENTIVE", F.lit(False)) & preventive))
    return out.withColumn("is_onset", F.coalesce(onset, F.lit(False))).drop("_broken", "_install")


def semantic(j: Journal, cfg: Config = DEFAULT, only: DataFrame | None = None) -> DataFrame:
    """Events with is_onset, is_recon, is_operational; with `only` (item), of these items alone: all lines of an item are there."""
    # of an order's type only RECON says anything: few orders have it, and events are not shuffled for the others
    recon = looked_up(work_order_types(j).where("order_type = 'RECON'"), "recon")
    e = with_onsets(clean_events(j, cfg, only)).join(recon, F.col("wo_code") == F.col("w_code"), "left").drop("w_code")
    low = F.unix_micros(F.lit(cfg.oldest_date).cast("timestamp"))
    now = F.unix_micros(F.lit(cfg.now).cast("timestamp"))
    valid = F.col("created_us").isNotNull() & (F.col("created_us") >= low) & (F.col("created_us") <= now)
    e = e.withColumn("is_recon", X.is_recon(*[F.col(c) for c in ("wo_type", "order_type", "status", "activity", "done_by", "remark")]))
    return e.withColumn("is_operational", F.coalesce(valid, F.lit(False)) & ~F.col("is_recon"))


def operational(sem: DataFrame) -> DataFrame:
    return sem.where("is_operational AND item IS NOT NULL")


def data_boundary(sem: DataFrame) -> DataFrame:
    return sem.where("is_operational").agg(F.max("created_us").alias("data_end_us"))


def inventory_identity(j: Journal) -> DataFrame:
    """(lookup, identifier): distinct models, whether one is null, the first. One scan for three kinds of identifier."""
    i = j.item().select(
        X.clean(F.col("item_pairing_code")).alias("pairing"),
        X.clean(F.col("sn_ref")).alias("sn"),
        X.host_serial(F.col("item_model_code"), F.col("item_pairing_code"), F.col("repair_seq")).alias("host"),
        X.clean(F.col("item_model_code")).alias("model"),
    ).distinct()
    kinds = F.array(*[F.struct(F.lit(kind).alias("lookup"), F.col(column).alias("identifier")) for kind, column in (("PAIRING", "pairing"), ("HOST", "host"), ("HOST", "sn"))])
    v = i.select("model", F.explode(kinds).alias("k")).select("model", "k.lookup", "k.identifier").where("identifier IS NOT NULL")
    return v.groupBy("lookup", "identifier").agg(F.count_distinct("model").alias("models"), F.bool_or(F.col("model").isNull()).alias("has_null_model"), F.min("model").alias("only_model"))


def with_inventory(df: DataFrame, identity: DataFrame) -> DataFrame:
    """df (pairing, host, model) with `known`: the inventory knows the item and does not contradict its model."""

    def side(kind: str, p: str) -> DataFrame:
        return identity.where(F.col("lookup") == kind).select(*[F.col(c).alias(f"{p}_{c}") for c in ("identifier", "models", "has_null_model", "only_model")])

    def agrees(p: str) -> Column:
        c = lambda x: F.col(f"{p}_{x}")
        return F.when(c("identifier").isNull(), True).when(F.col("model").isNull(), c("models") == 0).otherwise(~c("has_null_model") & (c("models") == 1) & (c("only_model") == F.col("model")))

    both = df.join(side("PAIRING", "pl"), F.col("pairing") == F.col("pl_identifier"), "left").join(side("HOST", "hl"), F.col("host") == F.col("hl_identifier"), "left")
    known = (F.col("pl_identifier").isNotNull() | F.col("hl_identifier").isNotNull()) & agrees("pl") & agrees("hl")
    return both.withColumn("known", F.coalesce(known, F.lit(False))).select(*df.columns, "known")


def episodes(sem: DataFrame, identity: DataFrame) -> DataFrame:
    """Every failure onset, also before the first install."""
    rows = with_inventory(sem.where("is_onset"), identity)
    return rows.select(F.col("journey_id").alias("onset_journey_id"), "item", F.col("created_us").alias("onset_us"), "item_type", "model", (F.col("known") & F.coalesce(F.col("category") == "PART", F.lit(False))).alias("in_cohort"))


def cycles(sem: DataFrame, identity: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """One row an installation, with how it ended.

    Failures find their cycle by the running number of installs: one window pass instead of a range join.
    """
    by_item = Window.partitionBy("item").orderBy(F.col("created_us").asc_nulls_last(), "journey_id")
    op = operational(sem)
    end = data_boundary(sem)
    is_install = F.coalesce(F.col("is_operational") & (F.col("status") == "INSTALLED") & (F.col("category") == "PART"), F.lit(False))
    stream = sem.where(F.col("item").isNotNull() & (is_install | F.col("is_onset")))
    stream = stream.withColumn("install", is_install.cast("int")).withColumn("seq", F.sum("install").over(by_item.rowsBetween(Window.unboundedPreceding, 0)))
    first_failure = stream.where("install = 0 AND seq > 0").groupBy(F.col("item").alias("f_item"), F.col("seq").alias("f_seq")).agg(F.min_by("created_us", F.struct(F.col("created_us").isNull(), "created_us", "journey_id")).alias("onset_us"))
    installs = stream.where("install = 1").withColumn("next_us", F.lead("created_us").over(by_item))
    last_seen = op.groupBy("item").agg(F.max("created_us").alias("seen_us"))
    recon = sem.where("is_recon AND item IS NOT NULL").groupBy("item").agg(F.max("created_us").alias("recon_us"))
    after = last_seen.join(recon, "item").where("recon_us > seen_us").select(F.col("item").alias("r_item"))
    rows = installs.join(first_failure, (F.col("item") == F.col("f_item")) & (F.col("seq") == F.col("f_seq")), "left").join(after, F.col("item") == F.col("r_item"), "left").crossJoin(F.broadcast(end))  # one row
    rows = with_inventory(rows.drop("known"), identity)
    rows = rows.withColumn("end_us", F.coalesce("onset_us", "next_us", "data_end_us"))
    reason = F.when(F.col("onset_us").isNotNull(), "FAILURE").when(F.col("next_us").isNotNull(), "REINSTALL_WITHOUT_RECORDED_FAILURE").otherwise("RIGHT_CENSORED_AT_DATA_END")
    previous = Window.partitionBy("item").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(
        F.concat("item", F.lit(":"), F.col("seq").cast("string")).alias("cycle_id"),
        "item",
        F.col("seq").cast("long").alias("seq"),
        F.col("created_us").alias("installed_us"),
        "model",
        "item_type",
        "client",
        "place",
        "onset_us",
        "end_us",
        reason.alias("end_reason"),
        "data_end_us",
        (F.col("onset_us").isNotNull() | (F.col("next_us").isNull() & F.col("r_item").isNull())).alias("verified"),
        (F.col("known") & (F.col("created_us") < F.col("end_us"))).alias("in_cohort"),
        (F.least("end_us", "data_end_us") - cfg.horizon_days * DAY).alias("last_confirmable_us"),
        F.avg(X.days(F.col("created_us"), F.col("end_us"))).over(previous).alias("previous_mean_days"),
        (F.count("*").over(previous) > 0).alias("has_previous"),
    )


def terminal_links(j: Journal, sem: DataFrame) -> DataFrame:
    """Install events with their parent device and the state of that link; of several requests the valid, earliest, first one."""
    installs = operational(sem).where("status = 'INSTALLED' AND category = 'PART'")
    requests = j.request_out().select("item_request_out_id", X.clean(F.col("item_serial_code_out")).alias("q_host"), X.clean(F.col("wo_code")).alias("q_wo"), "parent_serial_code", "recorded_us")
    requests = requests.withColumn("p_model", X.serial_part(F.col("parent_serial_code"), 1)).withColumn("p_pairing", X.serial_part(F.col("parent_serial_code"), 2))
    models = j.item_model().select(F.col("item_model_code").alias("m_code"), X.clean(F.col("item_category")).alias("parent_category"), X.clean(F.col("item_type")).alias("terminal_type"), X.clean(F.col("item_model_name")).alias("terminal_model"))
    stock = j.item().groupBy(F.col("item_pairing_code").alias("i_pairing")).agg(F.min("item_id").alias("terminal_item_id"))
    rows = (
        installs.join(requests, (F.col("host") == F.col("q_host")) & (F.col("wo_code") == F.col("q_wo")), "left")
        .join(models, F.col("p_model") == F.col("m_code"), "left")
        .join(stock, F.col("p_pairing") == F.col("i_pairing"), "left")
    )
    state = (
        F.when(F.col("item_request_out_id").isNull(), "UNMATCHED_INSTALLATION_REQUEST")
        .when(F.nullif(F.trim("parent_serial_code"), F.lit("")).isNull(), "MISSING_PARENT_SERIAL")
        .when(~F.col("parent_category").eqNullSafe("TERMINAL"), "PARENT_NOT_TERMINAL")
        .when(F.col("terminal_item_id").isNull(), "PARENT_TERMINAL_NOT_IN_INVENTORY")
        .when(F.col("recorded_us") > F.col("created_us"), "VALID_RELATION_RECORDED_AFTER_INSTALLATION")
        .otherwise("VALID_POINT_IN_TIME_RELATION")
    )
    rows = rows.withColumn("link_state", state)
    order = Window.partitionBy("journey_id").orderBy(F.col("link_state") != "VALID_POINT_IN_TIME_RELATION", F.col("recorded_us").asc_nulls_last(), F.col("item_request_out_id").asc_nulls_last())
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("journey_id", "item", F.col("created_us").alias("installed_us"), F.col("p_model").alias("terminal_code"), "terminal_type", "terminal_model", "link_state")
