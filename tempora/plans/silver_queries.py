"""Queries on cleaned events, onsets, cycles, episodes and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions.tables import stored
from ..operators import canonical, silver
from ..sources.journal import Journal
from .oracle import sql
from .registry import query

EVENT = ["journey_id", "category", "item_type", "model", "pairing", "host", "item", "client", "place", "wo_type", "wo_code", "activity", "status", "done_by", "remark", "created_us"]


@query("clean_events", sql(f"SELECT {', '.join(EVENT)} FROM event"))
def _(spark, d):
    return silver.clean_events(Journal(spark, d)).select(*EVENT)


@query("canonical_clients", sql("SELECT * FROM client_map"))
def _(spark, d):
    j = Journal(spark, d)
    return canonical.canonical_map(j.item_journey().select(F.col("client").alias("source")), j.clients(), DEFAULT.client_alias)


@query("canonical_places", sql("SELECT * FROM place_map"))
def _(spark, d):
    j = Journal(spark, d)
    return canonical.canonical_map(j.item_journey().select(F.col("place").alias("source")), j.places(), DEFAULT.place_alias)


@query("work_order_types", sql("SELECT * FROM order_type"))
def _(spark, d):
    return silver.work_order_types(Journal(spark, d))


@query("recon_flags", sql("SELECT journey_id, is_recon FROM sem"))
def _(spark, d):
    return silver.semantic(Journal(spark, d)).select("journey_id", "is_recon")


@query("operational_events", sql("SELECT journey_id, item, created_us, wo_type, status, item_type, is_onset, place FROM op"))
def _(spark, d):
    return silver.operational(silver.semantic(Journal(spark, d))).select("journey_id", "item", "created_us", "wo_type", "status", "item_type", "is_onset", "place")


@query("data_boundary", sql("SELECT data_end_us FROM boundary"))
def _(spark, d):
    return silver.data_boundary(silver.semantic(Journal(spark, d)))


@query("inventory_identity", sql("SELECT * FROM identity"))
def _(spark, d):
    return silver.inventory_identity(Journal(spark, d))


@query("failure_onsets", sql("SELECT journey_id, item, created_us FROM sem WHERE is_onset"))
def _(spark, d):
    return silver.with_onsets(silver.clean_events(Journal(spark, d))).where("is_onset").select("journey_id", "item", "created_us")


@query("failure_episodes", sql("SELECT * FROM episode"))
def _(spark, d):
    j = Journal(spark, d)
    return silver.episodes(silver.semantic(j), silver.inventory_identity(j))


@query("cycles", sql("SELECT * FROM cycle"))
def _(spark, d):
    j = Journal(spark, d)
    return silver.cycles(stored(silver.semantic(j), "event"), silver.inventory_identity(j))




@query(
    "terminal_link",
    sql(
        """SELECT journey_id, item, installed_us, terminal_code, terminal_type, terminal_model, link_state FROM (
        SELECT s.*, row_number() OVER (PARTITION BY journey_id ORDER BY link_state <> 'VALID_POINT_IN_TIME_RELATION', recorded_us NULLS LAST, request_id NULLS LAST) AS r FROM link s) WHERE r = 1""",
        request="""SELECT journey_id AS request_id, upper(host_serial_code) AS q_host, wo_code AS q_wo, CASE WHEN journey_id % 7 <> 0 THEN CASE WHEN journey_id % 5 = 0 THEN 'NOWHERE' ELSE 'TERMINAL' END END AS p_model,
            CASE WHEN journey_id % 7 <> 0 THEN lpad(CAST(journey_id % 40 * 50 AS VARCHAR), 7, '0') END AS p_pairing, created_us + CASE WHEN journey_id % 2 = 0 THEN -5 ELSE 5 END * 86400000000 AS recorded_us
            FROM journal WHERE status = ' Installed' AND journey_id % 3 <> 0""",
        link="""SELECT i.journey_id, i.item, i.created_us AS installed_us, p_model AS terminal_code, CASE WHEN p_model = 'TERMINAL' THEN 'GATE' END AS terminal_type, CASE WHEN p_model = 'TERMINAL' THEN 'GATE READER' END AS terminal_model, recorded_us, request_id,
            CASE WHEN request_id IS NULL THEN 'UNMATCHED_INSTALLATION_REQUEST' WHEN p_model IS NULL THEN 'MISSING_PARENT_SERIAL' WHEN p_model <> 'TERMINAL' THEN 'PARENT_NOT_TERMINAL'
                 WHEN p_pairing NOT IN (SELECT item_pairing_code FROM inventory) THEN 'PARENT_TERMINAL_NOT_IN_INVENTORY' WHEN recorded_us > i.created_us THEN 'VALID_RELATION_RECORDED_AFTER_INSTALLATION' ELSE 'VALID_POINT_IN_TIME_RELATION' END AS link_state
            FROM op i LEFT JOIN request ON q_host = i.host AND q_wo = i.wo_code WHERE i.status = 'INSTALLED' AND i.category = 'PART'""",
    ),
)
def _(spark, d):
    j = Journal(spark, d)
    return silver.terminal_links(j, stored(silver.semantic(j), "event"))
