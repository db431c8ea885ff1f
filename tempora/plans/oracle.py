"""SQL of the same queries for DuckDB, written independently: common table expressions and final selects."""

from __future__ import annotations

DAY = 86_400_000_000


def c(x: str) -> str:
    return rf"nullif(upper(regexp_replace(trim({x}), '\s+', ' ', 'g')), '')"


def clip0(x: str) -> str:
    return f"greatest(coalesce(CAST({x} AS DOUBLE), 0.0), 0.0)"


def l1(x: str) -> str:
    return f"ln(1 + {clip0(x)})"


def fuzzy(x: str) -> str:
    return f"array_to_string(list_transform(list_filter(string_split(regexp_replace(upper({x}), '[^\\p{{L}}\\p{{N}}]', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: CASE WHEN w = 'JKT' THEN 'JAKARTA' ELSE w END), ' ')"


def canonical(name: str, source: str, master: str, alias: str = "SELECT NULL AS s, NULL AS n WHERE FALSE") -> dict[str, str]:
    return {
        f"{name}_src": f"SELECT DISTINCT {c(source)} AS source FROM journal WHERE {c(source)} IS NOT NULL",
        f"{name}_keys": f"SELECT key, count(DISTINCT name) AS n, min(name) AS name FROM (SELECT {c('code')} AS key, {c('name')} AS name FROM ({master}) UNION ALL SELECT {c('name')}, {c('name')} FROM ({master})) WHERE key IS NOT NULL AND name IS NOT NULL GROUP BY key",
        f"{name}_sim": f"SELECT s.source, m.name, round(1 - levenshtein({fuzzy('s.source')}, {fuzzy('m.name')}) / greatest(length({fuzzy('s.source')}), length({fuzzy('m.name')})), 4) AS score FROM {name}_src s, (SELECT DISTINCT {c('name')} AS name FROM ({master})) m WHERE s.source NOT IN (SELECT key FROM {name}_keys)",
        f"{name}_best": f"SELECT source, name, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, name) AS r, lead(score) OVER (PARTITION BY source ORDER BY score DESC, name) AS second FROM {name}_sim",
        f"{name}_map": f"""SELECT s.source, CASE WHEN k.n = 1 THEN k.name WHEN k.key IS NULL THEN b.name END AS canonical,
            CASE WHEN k.n = 1 THEN 'EXACT' WHEN k.key IS NULL AND b.name IS NOT NULL THEN 'FUZZY' ELSE 'UNMAPPED' END AS how
            FROM {name}_src s LEFT JOIN {name}_keys k ON k.key = s.source
            LEFT JOIN (SELECT * FROM {name}_best WHERE r = 1 AND score >= 0.9 AND round(score - coalesce(second, 0), 6) >= 0.08) b ON b.source = s.source""",
    }


CTE: dict[str, str] = {
    "numbered": "SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) AS n FROM lineitem",
    "journal": """SELECT l_partkey * 100000 + n AS journey_id,
        CASE WHEN l_partkey % 50 = 0 THEN 'TERMINAL' ELSE 'PART' END AS item_category, p_type AS item_type,
        CASE WHEN l_partkey % 211 <> 0 THEN p_brand END AS item_model_code,
        CASE WHEN l_partkey % 97 <> 0 THEN lpad(CAST(l_partkey AS VARCHAR), 7, '0') END AS item_pairing_code,
        p_brand || '-' || lpad(CAST(l_partkey AS VARCHAR), 7, '0') || '-1' AS host_serial_code,
        CASE WHEN c_custkey % 10 = 0 THEN substr(c_mktsegment, 1, 1) || 'X' || substr(c_mktsegment, 3) ELSE c_mktsegment END AS client,
        'STASIUN ' || CASE WHEN c_custkey % 10 = 0 THEN substr(n_name, 1, 1) || 'X' || substr(n_name, 3) ELSE n_name END AS place,
        CASE WHEN l_linestatus = 'F' THEN 'corrective' ELSE 'PREVENTIVE' END AS wo_type, CAST(l_orderkey AS VARCHAR) AS wo_code,
        CASE WHEN o_orderpriority = '5-LOW' AND l_orderkey % 10 = 0 AND l_linenumber % 3 = 0 THEN 'RECON' END AS activity,
        CASE WHEN o_orderpriority = '5-LOW' AND l_orderkey % 10 = 0 AND l_linenumber % 3 = 1 THEN 'recon team' END AS done_by,
        CASE WHEN o_orderpriority = '5-LOW' AND l_orderkey % 10 = 0 AND l_linenumber % 3 = 2 THEN 'by recon' END AS remark,
        CASE WHEN l_returnflag = 'R' THEN 'dismantled' WHEN l_returnflag = 'A' THEN ' Installed'
             WHEN l_linestatus = 'F' THEN CASE WHEN l_linenumber % 4 = 0 THEN 'UNREPAIRABLE' ELSE 'REPAIRED' END ELSE 'DELIVERY' END AS status,
        epoch_us(l_shipdate) AS created_us
        FROM numbered JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "inventory": """SELECT p_partkey * 10 + 1 AS item_id, lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS item_pairing_code, 'SN' || p_partkey AS sn_ref, CASE WHEN p_partkey % 211 <> 0 THEN p_brand END AS item_model_code, '1' AS repair_seq FROM part
        UNION ALL SELECT p_partkey * 10 + 2, lpad(CAST(p_partkey AS VARCHAR), 7, '0'), 'SN' || p_partkey, 'Other#1', '1' FROM part WHERE p_partkey % 17 = 0""",
    **canonical("client", "client", "SELECT substr(c_mktsegment, 1, 3) AS code, c_mktsegment AS name FROM customer"),
    **canonical("place", "place", "SELECT 'P' || n_nationkey AS code, 'STASIUN ' || n_name AS name FROM nation"),
    "event": f"""SELECT journey_id, {c('item_category')} AS category, {c('item_type')} AS item_type, {c('item_model_code')} AS model, {c('item_pairing_code')} AS pairing, {c('host_serial_code')} AS host,
        coalesce({c('item_pairing_code')}, {c('host_serial_code')}, 'JOURNEY#' || journey_id) AS item, cm.canonical AS client, pm.canonical AS place,
        {c('wo_type')} AS wo_type, {c('wo_code')} AS wo_code, {c('activity')} AS activity, {c('status')} AS status, {c('done_by')} AS done_by, upper(coalesce(remark, '')) AS remark, created_us
        FROM journal LEFT JOIN client_map cm ON cm.source = {c('client')} LEFT JOIN place_map pm ON pm.source = {c('place')}""",
    "types": "SELECT DISTINCT upper(substr(o_orderpriority, 1, 1)) AS t_code, upper(o_orderpriority) AS t_name FROM orders UNION ALL SELECT 'R', 'RECON'",
    "order_type": """SELECT w_code, order_type FROM (SELECT CAST(o_orderkey AS VARCHAR) AS w_code, coalesce(t_name, o_type) AS order_type,
        row_number() OVER (PARTITION BY o_orderkey ORDER BY coalesce(t_code, '')) AS r
        FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 400 = 0 THEN 'RECON' ELSE upper(o_orderpriority) END AS o_type FROM orders) LEFT JOIN types ON t_code = o_type OR t_name = o_type) WHERE r = 1""",
    "placed": """SELECT *, row_number() OVER (PARTITION BY item ORDER BY created_us, journey_id) AS ord FROM event WHERE created_us IS NOT NULL""",
    "nexts": """SELECT *, min(CASE WHEN status IN ('UNREPAIRABLE', 'BROKEN', 'SENDLOG (BROKEN)') THEN ord END) OVER w AS broken_ord, min(CASE WHEN status = 'INSTALLED' THEN ord END) OVER w AS install_ord
        FROM placed WINDOW w AS (PARTITION BY item ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)""",
    "sem": """SELECT n.* EXCLUDE (broken_ord, install_ord), coalesce(status = 'DISMANTLED' AND (wo_type = 'CORRECTIVE' OR (wo_type = 'PREVENTIVE' AND broken_ord IS NOT NULL AND (install_ord IS NULL OR broken_ord < install_ord))), FALSE) AS is_onset,
        order_type, coalesce(wo_type = 'RECON', FALSE) OR coalesce(order_type = 'RECON', FALSE) OR coalesce(status = 'DISMANTLED' AND activity = 'RECON', FALSE)
            OR coalesce(status = 'INSTALLED' AND (contains(coalesce(done_by, ''), 'RECON') OR contains(remark, 'RECON')), FALSE) AS is_recon
        FROM nexts n LEFT JOIN order_type ON w_code = wo_code""",
    "op": "SELECT * FROM sem WHERE NOT is_recon AND created_us >= 31536000000000 AND created_us <= 4102444800000000",
    "boundary": "SELECT max(created_us) AS data_end_us FROM op",
    "ident": f"""SELECT DISTINCT {c('item_pairing_code')} AS pairing, {c('sn_ref')} AS sn, {c("item_model_code || '-' || item_pairing_code || '-' || repair_seq")} AS host, {c('item_model_code')} AS model FROM inventory""",
    "identity": """SELECT lookup, identifier, count(DISTINCT model) AS models, bool_or(model IS NULL) AS has_null_model, min(model) AS only_model FROM (
        SELECT 'PAIRING' AS lookup, pairing AS identifier, model FROM ident UNION ALL SELECT 'HOST', host, model FROM ident UNION ALL SELECT 'HOST', sn, model FROM ident) WHERE identifier IS NOT NULL GROUP BY ALL""",
    "known": """SELECT s.*, coalesce((p.identifier IS NOT NULL OR h.identifier IS NOT NULL)
        AND CASE WHEN p.identifier IS NULL THEN TRUE WHEN s.model IS NULL THEN p.models = 0 ELSE NOT p.has_null_model AND p.models = 1 AND p.only_model = s.model END
        AND CASE WHEN h.identifier IS NULL THEN TRUE WHEN s.model IS NULL THEN h.models = 0 ELSE NOT h.has_null_model AND h.models = 1 AND h.only_model = s.model END, FALSE) AS known
        FROM sem s LEFT JOIN identity p ON p.lookup = 'PAIRING' AND p.identifier = s.pairing LEFT JOIN identity h ON h.lookup = 'HOST' AND h.identifier = s.host""",
    "episode": "SELECT journey_id AS onset_journey_id, item, created_us AS onset_us, item_type, model, known AND category = 'PART' AS in_cohort FROM known WHERE is_onset",
    "installed": """SELECT k.*, row_number() OVER w AS seq, lead(created_us) OVER w AS next_us, lead(ord) OVER w AS next_ord FROM known k
        WHERE status = 'INSTALLED' AND category = 'PART' AND NOT is_recon WINDOW w AS (PARTITION BY item ORDER BY ord)""",
    "cycle0": """SELECT i.*, (SELECT min(f.created_us) FROM sem f WHERE f.item = i.item AND f.is_onset AND f.ord > i.ord AND (i.next_ord IS NULL OR f.ord < i.next_ord)) AS onset_us,
        (SELECT data_end_us FROM boundary) AS data_end_us,
        (SELECT coalesce(bool_or(r.created_us > b.seen_us), FALSE) FROM sem r, (SELECT item, max(created_us) AS seen_us FROM op GROUP BY item) b WHERE r.item = i.item AND b.item = i.item AND r.is_recon) AS recon_after FROM installed i""",
    "cycle1": "SELECT *, coalesce(onset_us, next_us, data_end_us) AS end_us FROM cycle0",
    "cycle": f"""SELECT item || ':' || seq AS cycle_id, item, seq, created_us AS installed_us, model, item_type, client, place, onset_us, end_us,
        CASE WHEN onset_us IS NOT NULL THEN 'FAILURE' WHEN next_us IS NOT NULL THEN 'REINSTALL_WITHOUT_RECORDED_FAILURE' ELSE 'RIGHT_CENSORED_AT_DATA_END' END AS end_reason, data_end_us,
        onset_us IS NOT NULL OR (next_us IS NULL AND NOT recon_after) AS verified, known AND created_us < end_us AS in_cohort, least(end_us, data_end_us) - 30 * {DAY} AS last_confirmable_us,
        (SELECT avg((p.end_us - p.created_us) / {DAY}.0) FROM cycle1 p WHERE p.item = y.item AND p.seq < y.seq) AS previous_mean_days, seq > 1 AS has_previous FROM cycle1 y""",
}


def sql(select: str, held: bool = False, **more: str) -> str:
    """A final select over the expressions above and those given; held: each is worked out once."""
    parts = CTE | more
    return "WITH " + ",\n".join(f"{k} AS {'MATERIALIZED ' * held}({v})" for k, v in parts.items()) + "\n" + select
