"""Sources, sinks, sessions, attempts and reports, over tables derived from the given ones."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from tabulon.functions import bounded, text as T
from tabulon.functions.columns import union_all
from tabulon.operators import profile as P
from tabulon.operators import reports as D
from tabulon.operators import sessions as S
from tabulon.operators.dependencies import run_order
from tabulon.operators.splits import hash_split
from tabulon.plans.catalog import query, table
from tabulon.plans.queries_features import case_split
from tabulon.plans.run import run
from tabulon.sources import readers, sinks, store
from tabulon.sources.workbooks import parse_workbooks
from tabulon.session import scratch_path
from tabulon.streaming.slots import folded_sessions, start_fold

ORDER_SCHEMA = (
    "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string"
)
ORDER_ROWS = """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
    strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders"""


def day_text(df):
    return df.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


@query("csv_scan", ORDER_ROWS)
def csv_scan(spark, sf):
    path = scratch_path(spark, "csv")
    table(spark, sf, "orders").write.option("header", True).csv(path)
    return day_text(readers.read_table(spark, path, "csv", ORDER_SCHEMA))


@query("csv_scan_inferred", "SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def csv_scan_inferred(spark, sf):
    path = scratch_path(spark, "csv")
    table(spark, sf, "part").write.option("header", True).csv(path)
    out = readers.read_table(spark, path, "csv")
    return out.select(F.col("p_partkey").cast("long"), "p_name", "p_size", "p_retailprice")


@query("parquet_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def parquet_scan(spark, sf):
    o = readers.read_table(spark, f"{sf}/orders.parquet", "parquet")
    return o.where("o_orderstatus = 'F' AND o_totalprice > 100000").select("o_orderkey", "o_totalprice")


@query("dataset_dispatch", "SELECT p_partkey, p_brand, p_size FROM part")
def dataset_dispatch(spark, sf):
    info = {"data_path": "part.parquet", "data_type": "parquet"}
    return readers.load_dataset(spark, info, base=sf).select("p_partkey", "p_brand", "p_size")


def workbook(frame: pd.DataFrame) -> bytes:
    """A minimal workbook of text cells, header first."""
    ns = "http://schemas.openxmlformats.org"
    cell = lambda v: f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'
    rows = [frame.columns, *frame.itertuples(index=False)]
    sheet = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(
            "xl/workbook.xml",
            f'<workbook xmlns="{ns}/spreadsheetml/2006/main" xmlns:r="{ns}/officeDocument/2006/relationships">'
            '<sheets><sheet name="data" sheetId="1" r:id="rId1"/></sheets></workbook>',
        )
        z.writestr(
            "xl/_rels/workbook.xml.rels",
            f'<Relationships xmlns="{ns}/package/2006/relationships">'
            '<Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        )
        z.writestr(
            "xl/worksheets/sheet1.xml",
            f'<worksheet xmlns="{ns}/spreadsheetml/2006/main"><sheetData>{sheet}</sheetData></worksheet>',
        )
    return out.getvalue()


@query("excel_scan", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def excel_scan(spark, sf):
    """Every Arrow batch of `customer` becomes one workbook; all of them are parsed back."""

    def books(batches):
        for i, batch in enumerate(batches):
            yield pd.DataFrame({"path": [f"book-{i}.xlsx"], "content": [workbook(batch)]})

    customer = table(spark, sf, "customer")
    return parse_workbooks(customer.mapInPandas(books, "path string, content binary"), customer.schema)


def typed_workbook(frame: pd.DataFrame) -> bytes:
    """A workbook with cells of their type: texts as shared strings, dates as styled numbers, booleans."""
    ns = "http://schemas.openxmlformats.org"
    words: dict[str, int] = {}

    def cell(v) -> str:
        if pd.isna(v):
            return "<c/>"
        if isinstance(v, str):
            return f'<c t="s"><v>{words.setdefault(v, len(words))}</v></c>'
        if isinstance(v, bool):
            return f'<c t="b"><v>{int(v)}</v></c>'
        if isinstance(v, pd.Timestamp):
            return f'<c s="1"><v>{(v - pd.Timestamp(1899, 12, 30)).total_seconds() / 86400!r}</v></c>'
        return f"<c><v>{v!r}</v></c>"

    rows = [frame.columns, *zip(*[frame[c].tolist() for c in frame])]
    sheet = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(
            "xl/workbook.xml",
            f'<workbook xmlns="{ns}/spreadsheetml/2006/main" xmlns:r="{ns}/officeDocument/2006/relationships">'
            '<sheets><sheet name="data" sheetId="1" r:id="rId1"/></sheets></workbook>',
        )
        z.writestr(
            "xl/_rels/workbook.xml.rels",
            f'<Relationships xmlns="{ns}/package/2006/relationships">'
            '<Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        )
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{ns}/spreadsheetml/2006/main"><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs></styleSheet>')
        texts = "".join(f'<si><t xml:space="preserve">{escape(w)}</t></si>' for w in words)
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}/spreadsheetml/2006/main">{texts}</sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}/spreadsheetml/2006/main"><sheetData>{sheet}</sheetData></worksheet>')
    return out.getvalue()


@query(
    "excel_typed_scan",
    """SELECT o_orderkey, o_orderpriority, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderstatus = 'O' AS is_open,
    CASE WHEN o_orderkey % 5 > 0 THEN o_custkey END AS o_custkey FROM orders""",
)
def excel_typed_scan(spark, sf):
    """Workbooks of 10,000 orders each, with numbers, dates, booleans, texts and gaps; types come from the cells."""

    def books(batches):
        for i, batch in enumerate(batches):
            yield pd.DataFrame({"path": [f"book-{i}.xlsx"], "content": [typed_workbook(batch)]})

    rows = table(spark, sf, "orders").select(
        "o_orderkey", "o_orderpriority", "o_totalprice", F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"),
        (F.col("o_orderstatus") == "O").alias("is_open"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_custkey")).cast("string").cast("double").alias("o_custkey"),
    )
    found = parse_workbooks(rows.mapInPandas(books, "path string, content binary"))
    return day_text(found.withColumn("o_custkey", F.col("o_custkey").cast("long")))


@query(
    "text_scan",
    """SELECT length(line) AS line_length, count(*) AS "lines" FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)
    GROUP BY 1""",
)
def text_scan(spark, sf):
    path = scratch_path(spark, "text")
    table(spark, sf, "documents").select("text").write.text(path)
    lines = readers.read_table(spark, path, "text")
    return lines.groupBy(F.length("value").cast("long").alias("line_length")).agg(F.count("*").alias("lines"))


@query(
    "image_listing",
    """SELECT doc_id // 50 AS bucket, CAST(sum(strlen(coalesce(source, '')) + 1) AS BIGINT) AS length FROM documents GROUP BY 1""",
)
def image_listing(spark, sf):
    """File listing as used for image datasets, over one file written for every fifty documents."""
    path = scratch_path(spark, "images")
    rows = table(spark, sf, "documents").select(F.expr("doc_id div 50").alias("bucket"), F.coalesce("source", F.lit("")).alias("value"))
    rows.repartition("bucket").write.partitionBy("bucket").text(path)
    key = F.regexp_extract("path", "bucket=([0-9]+)/", 1).cast("long").alias("bucket")
    return readers.read_table(spark, path, "images").select(key, "length")


@query(
    "document_scan",
    """SELECT CASE WHEN o_orderstatus <> 'P' THEN o_orderkey END AS session_id,
    CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS task_type, o_orderstatus <> 'P' AS is_valid FROM orders""",
)
def document_scan(spark, sf):
    doc = F.to_json(F.struct(F.col("o_orderkey").alias("session_id"), F.col("o_orderpriority").alias("task_type")))
    broken = F.left(doc, F.length(doc) - 2)
    path = scratch_path(spark, "documents")
    table(spark, sf, "orders").select(F.when(F.col("o_orderstatus") == "P", broken).otherwise(doc).alias("value")).write.text(path)
    docs = readers.read_documents(spark, path, "session_id long, task_type string", whole_files=False)
    return docs.select("doc.session_id", "doc.task_type", "is_valid")


@query(
    "split_sink",
    f"""SELECT split, count(*) AS "rows", round(sum(o_totalprice), 2) AS total FROM
    (SELECT {case_split('o_orderkey')} AS split, o_totalprice FROM orders) GROUP BY 1""",
)
def split_sink(spark, sf):
    path = scratch_path(spark, "splits")
    sinks.write_splits(hash_split(table(spark, sf, "orders"), "o_orderkey"), path)
    out = spark.read.parquet(path)
    return out.groupBy("split").agg(F.count("*").alias("rows"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    "report_sink",
    """SELECT 'EDAAgent' AS stage, 'failed' AS pipeline_status, 'target column species not found' AS pipeline_status_reason,
    count(*) AS "rows", CAST(5 AS BIGINT) AS columns_profiled FROM customer""",
)
def report_sink(spark, sf):
    df = table(spark, sf, "customer")
    path = scratch_path(spark, "report")
    sinks.write_report(P.profile_status(df, P.profile(df), "species"), path)
    return readers.read_table(
        spark, path, "json",
        "stage string, pipeline_status string, pipeline_status_reason string, rows long, columns_profiled long",
    )


@query(
    "session_upsert",
    """SELECT user_id, event_id, event_type, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def session_upsert(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value", "ts")
    old, new = e.where("event_type <> 'signup'"), e.where("event_type = 'signup'")
    return sinks.upsert(old, new, ["user_id"], ["ts", "event_id"]).drop("ts")


@query(
    "store_upsert",
    """SELECT user_id, event_id, event_type, value FROM events WHERE ts IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def store_upsert(spark, sf):
    """Events come in three updates, the last one twice; the store has each user's latest."""
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value", "ts")
    path, merge = scratch_path(spark, "store"), store.latest_rows(["user_id"], ["ts", "event_id"])
    updates = [e.where("event_id % 3 = 0"), e.where("event_id % 3 = 1"), e.where("event_id % 3 = 2")]
    for number in (0, 1, 2, 2):
        store.update_store(updates[number], path, ["user_id"], merge, number, buckets=16)
    return store.read_store(spark, path).drop("ts")


#: Every supplier's number is a stage that requires its half and its third; some require their double.
REQUIRED = {"s_suppkey div 2": "s_suppkey >= 2", "s_suppkey div 3": "s_suppkey >= 3", "s_suppkey * 2": "s_suppkey % 100 = 6"}


def required_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT s_suppkey AS stage, {v.replace('div', '//')} AS requires FROM supplier WHERE {when}" for v, when in REQUIRED.items()
    ) + " UNION ALL SELECT s_suppkey, NULL FROM supplier"


@query(
    "dependency_order",
    f"""WITH RECURSIVE edges AS (SELECT 's' || stage AS stage, 's' || requires AS requires FROM ({required_sql()})),
    reach AS (SELECT stage, requires FROM edges WHERE requires IS NOT NULL
        UNION SELECT r.stage, e.requires FROM reach r JOIN edges e ON e.stage = r.requires WHERE e.requires IS NOT NULL),
    names AS (SELECT stage FROM edges UNION SELECT requires FROM edges WHERE requires IS NOT NULL),
    known AS (SELECT n.stage, (SELECT count(*) FROM reach r WHERE r.stage = n.stage) AS size,
        (SELECT min(r.requires) FROM reach r JOIN reach c ON c.stage = r.requires AND c.requires = r.requires WHERE r.stage = n.stage) AS knot
        FROM names n),
    asked AS (SELECT DISTINCT c_custkey AS session_id, 's' || stage AS stage FROM (
        SELECT c_custkey, unnest([c_custkey % 90 + 1, c_nationkey, c_custkey % 7 * 1000]) AS stage FROM customer)),
    need AS (SELECT session_id, stage FROM asked JOIN known USING (stage) WHERE knot IS NULL
        UNION SELECT a.session_id, r.requires FROM asked a JOIN known k ON k.stage = a.stage AND knot IS NULL JOIN reach r ON r.stage = a.stage)
    SELECT session_id, stage, row_number() OVER (PARTITION BY session_id ORDER BY size, stage) AS position, NULL::VARCHAR AS reason
    FROM need JOIN known USING (stage)
    UNION ALL SELECT session_id, stage, NULL, CASE WHEN known.stage IS NULL THEN 'unknown stage' ELSE 'requires itself: ' || knot END
    FROM asked LEFT JOIN known USING (stage) WHERE known.stage IS NULL OR knot IS NOT NULL""",
)
def dependency_order(spark, sf):
    s = table(spark, sf, "supplier")
    label = lambda c: F.concat(F.lit("s"), F.expr(c).cast("string"))
    edges = [s.where(when).select(label("s_suppkey").alias("stage"), label(v).alias("requires")) for v, when in REQUIRED.items()]
    edges.append(s.select(label("s_suppkey").alias("stage"), F.lit(None).cast("string").alias("requires")))
    asked = F.explode(F.expr("array(c_custkey % 90 + 1, c_nationkey, c_custkey % 7 * 1000)"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("session_id"), asked.alias("stage"))
    return run_order(c.select("session_id", label("stage").alias("stage")), union_all(edges))


# Stage requests per customer: every spelling and combination the rules distinguish.
REQUESTS = {
    "AUTOMOBILE": ["FeatureEngineeringAgent"],
    "BUILDING": ["ModelTrainingAgent", "EDAAgent", "ModelTrainingAgent"],
    "FURNITURE": ["ReportAgent", "EdaAgent"],
    "HOUSEHOLD": ["PlotAgent"],
    "MACHINERY": ["EdaAgent", "featureengineeringagent", "Deploy"],
}
EXPANDED = {
    "AUTOMOBILE": ["EDAAgent", "FeatureEngineeringAgent"],
    "BUILDING": ["EDAAgent", "FeatureEngineeringAgent", "ModelTrainingAgent"],
    "FURNITURE": ["EDAAgent"],
    "HOUSEHOLD": [],
    "MACHINERY": ["EDAAgent", "FeatureEngineeringAgent"],
}


def requests(spark, sf):
    c = table(spark, sf, "customer")
    asked = F.array().cast("array<string>")
    for segment, names in REQUESTS.items():
        asked = F.when(F.col("c_mktsegment") == segment, F.array(*[F.lit(n) for n in names])).otherwise(asked)
    return c.select(F.col("c_custkey").alias("session_id"), F.col("c_nationkey"), asked.alias("agents_to_call"))


def requested_sql() -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in REQUESTS.items())
    return f"(SELECT c_custkey AS session_id, c_nationkey, CASE c_mktsegment {cases} END AS asked FROM customer)"


STAGE_TABLE = """s(stage, rank, requires) AS (VALUES ('EDAAgent', 0, NULL), ('FeatureEngineeringAgent', 1, 'EDAAgent'),
    ('ModelTrainingAgent', 2, 'FeatureEngineeringAgent'))"""
NEEDED = f"""RECURSIVE {STAGE_TABLE}, q AS (SELECT session_id, unnest(asked) AS name FROM {requested_sql()}),
    need AS (SELECT DISTINCT session_id, stage FROM q JOIN s ON lower(name) = lower(stage)
    UNION SELECT session_id, requires FROM need JOIN s USING (stage) WHERE requires IS NOT NULL)"""


@query("prerequisite_expansion", f"WITH {NEEDED} SELECT session_id, stage FROM need")
def prerequisite_expansion(spark, sf):
    return requests(spark, sf).select("session_id", F.explode(S.run_list(F.col("agents_to_call"))).alias("stage"))


@query(
    "ordered_run_list",
    f"""WITH {NEEDED} SELECT c_custkey AS session_id, coalesce(string_agg(stage, ',' ORDER BY rank), '') AS stages
    FROM customer LEFT JOIN need ON session_id = c_custkey LEFT JOIN s USING (stage) GROUP BY 1""",
)
def ordered_run_list(spark, sf):
    return requests(spark, sf).select("session_id", F.array_join(S.run_list(F.col("agents_to_call")), ",").alias("stages"))


@query(
    "unknown_requests",
    f"""WITH {STAGE_TABLE}, q AS (SELECT session_id, unnest(asked) AS name FROM {requested_sql()})
    SELECT DISTINCT session_id, name AS unknown FROM q WHERE lower(name) NOT IN (SELECT lower(stage) FROM s)""",
)
def unknown_requests(spark, sf):
    return requests(spark, sf).select("session_id", F.explode(S.unknown_stages(F.col("agents_to_call"))).alias("unknown"))


AFTER = "CASE c_nationkey % 4 WHEN 1 THEN 'EDAAgent' WHEN 2 THEN 'FeatureEngineeringAgent' WHEN 3 THEN 'ModelTrainingAgent' END"


@query(
    "next_stage",
    f"""WITH {NEEDED}, a AS (SELECT c_custkey AS session_id, coalesce((SELECT rank FROM s WHERE stage = {AFTER}), -1) AS done FROM customer),
    l AS (SELECT session_id, stage, rank FROM need JOIN s USING (stage))
    SELECT a.session_id, coalesce(arg_min(stage, rank) FILTER (WHERE rank > done), 'END') AS next_stage
    FROM a LEFT JOIN l ON l.session_id = a.session_id GROUP BY 1""",
)
def next_stage(spark, sf):
    after = F.try_element_at(F.array(*[F.lit(s) for s in T.STAGES]), F.nullif((F.col("c_nationkey") % 4).cast("int"), F.lit(0)))
    return requests(spark, sf).select(
        "session_id", S.next_stage(S.run_list(F.col("agents_to_call")), after).alias("next_stage")
    )


SESSION_FIELDS = """SELECT o_orderkey AS session_id, CASE o_orderstatus WHEN 'F' THEN concat('/data/', o_custkey, '.csv') WHEN 'O' THEN '' END AS data_path,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'regression' WHEN '2-HIGH' THEN '' WHEN '3-MEDIUM' THEN NULL ELSE 'classification' END AS task_type,
    CASE WHEN o_totalprice > 300000 THEN ['EDAAgent'] WHEN o_totalprice > 100000 THEN ['PlotAgent'] WHEN o_totalprice > 50000 THEN [] END AS agents FROM orders"""


def order_sessions(spark, sf):
    o, price = table(spark, sf, "orders"), F.col("o_totalprice")
    prio = F.col("o_orderpriority")
    none = F.array().cast("array<string>")
    return o.select(
        F.col("o_orderkey").alias("session_id"),
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("/data/"), F.col("o_custkey").cast("string"), F.lit(".csv")))
        .when(F.col("o_orderstatus") == "O", "").alias("data_path"),
        F.when(prio == "1-URGENT", "regression").when(prio == "2-HIGH", "").when(prio == "3-MEDIUM", None)
        .otherwise("classification").alias("task_type"),
        F.when(price > 300000, F.array(F.lit("EDAAgent"))).when(price > 100000, F.array(F.lit("PlotAgent")))
        .when(price > 50000, none).alias("agents_to_call"),
    )


@query(
    "completeness",
    f"""WITH s AS ({SESSION_FIELDS}) SELECT session_id, concat_ws(',', CASE WHEN coalesce(data_path, '') = '' THEN 'data_path' END,
    CASE WHEN coalesce(task_type, '') = '' THEN 'task_type' END, CASE WHEN coalesce(len(agents), 0) = 0 THEN 'agents_to_call' END) AS missing_slots,
    coalesce(data_path, '') <> '' AND coalesce(task_type, '') <> '' AND coalesce(len(agents), 0) > 0 AS is_complete FROM s""",
)
def completeness(spark, sf):
    out = S.missing_slots(order_sessions(spark, sf))
    return out.select("session_id", F.array_join("missing_slots", ",").alias("missing_slots"), "is_complete")


@query(
    "session_status",
    f"""WITH s AS ({SESSION_FIELDS}), r AS (SELECT l_orderkey, bool_and(l_returnflag <> 'R') AS ok,
    'item ' || min(l_linenumber) FILTER (WHERE l_returnflag = 'R') || ' returned' AS error FROM lineitem GROUP BY 1)
    SELECT session_id, CASE WHEN ok IS NULL THEN 'init' WHEN NOT ok OR coalesce(NOT list_contains(agents, 'EDAAgent'), TRUE) THEN 'failed' ELSE 'completed' END AS status,
    CASE WHEN ok IS NULL THEN NULL WHEN coalesce(NOT list_contains(agents, 'EDAAgent'), TRUE) THEN 'no valid stage requested' WHEN NOT ok THEN error END AS last_error
    FROM s LEFT JOIN r ON l_orderkey = session_id""",
)
def session_status(spark, sf):
    sessions = order_sessions(spark, sf).select(
        "session_id", "agents_to_call", F.lit("init").alias("status"), F.lit(None).cast("string").alias("last_error")
    )
    returned = F.col("l_returnflag") == "R"
    runs = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("session_id")).agg(
        F.bool_and(~returned).alias("success"),
        F.concat(F.lit("item "), F.min(F.when(returned, F.col("l_linenumber"))).cast("string"), F.lit(" returned")).alias("error"),
    )
    return S.update_status(sessions, runs).select("session_id", "status", "last_error")


# Attempts: a user's events in time order are the executions of one run.
STDERR = """CASE WHEN event_type = 'view' THEN '  ' || chr(10) || chr(9) WHEN event_type = 'click' THEN 'KeyError: ' || CAST(user_id % 3 AS VARCHAR)
    ELSE 'Traceback (most recent call last):' || chr(10) || '  line ' || CAST(event_id AS VARCHAR) || chr(13) || chr(10) || 'ValueError: case '
    || CAST(CAST(floor(value / 40) AS INTEGER) AS VARCHAR) || chr(10) || '  ' || chr(10) END"""
ATTEMPTS = f"""(SELECT user_id AS run_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS attempt,
    event_type = 'purchase' AS success, {STDERR} AS stderr FROM events)"""
SIGNATURE = r"""coalesce(list_filter(regexp_split_to_array(regexp_replace(stderr, '^\s+|\s+$', '', 'g'), '\r\n|\r|\n'), lambda l: regexp_matches(l, '\S'))[-1], '')"""


def attempts(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), "ts", "event_id",
        (F.col("event_type") == "purchase").alias("success"),
        F.when(F.col("event_type") == "view", "  \n\t")
        .when(F.col("event_type") == "click", F.concat(F.lit("KeyError: "), (F.col("user_id") % 3).cast("string")))
        .otherwise(
            F.concat(
                F.lit("Traceback (most recent call last):\n  line "), F.col("event_id").cast("string"),
                F.lit("\r\nValueError: case "), F.floor(F.col("value") / 40).cast("string"), F.lit("\n  \n"),
            )
        ).alias("stderr"),
    )
    return S.positions(e, ["run_id"], ["ts", "event_id"], "attempt").drop("ts", "event_id")


@query(
    "latest_attempt",
    f"""SELECT run_id, attempt, success, CASE WHEN success OR attempt >= 4 THEN 'save' ELSE 'verify' END AS route FROM {ATTEMPTS}
    QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY attempt DESC) = 1""",
)
def latest_attempt(spark, sf):
    return S.latest_attempt(attempts(spark, sf))


@query("error_frequency", f'SELECT {SIGNATURE} AS signature, count(*) AS "count" FROM {ATTEMPTS} WHERE NOT success GROUP BY 1')
def error_frequency(spark, sf):
    return S.error_frequency(attempts(spark, sf))


@query(
    "repeated_errors",
    f"""WITH f AS (SELECT run_id, attempt, {SIGNATURE} AS signature FROM {ATTEMPTS} WHERE NOT success)
    SELECT run_id, attempt, signature, coalesce(signature = lag(signature) OVER (PARTITION BY run_id ORDER BY attempt), FALSE) AS is_repeat FROM f""",
)
def repeated_errors(spark, sf):
    return S.repeated_errors(attempts(spark, sf)).select("run_id", "attempt", "signature", "is_repeat")


@query(
    "conversation_replay",
    "SELECT conv_id, turn, role, text, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS position FROM conversations",
)
def conversation_replay(spark, sf):
    return S.replay(table(spark, sf, "conversations"))


@query(
    "id_membership",
    "SELECT o_orderkey, o_custkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AS exists FROM orders".replace("AS exists", 'AS "exists"'),
)
def id_membership(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return S.members(orders, "o_custkey", table(spark, sf, "customer").where("c_acctbal > 0"), "c_custkey")


@query(
    "id_assignment",
    """SELECT c_custkey, CAST((SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY c_custkey) AS BIGINT) AS session_id FROM customer""",
)
def id_assignment(spark, sf):
    registry = table(spark, sf, "orders").select(F.col("o_orderkey").alias("session_id"))
    return S.assign_ids(registry, table(spark, sf, "customer").select("c_custkey"), "c_custkey")


# Reports: one per event, in every state the checks distinguish.
REPORT = """CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN '{"pipeline_status": "success", "model": ' WHEN 'signup' THEN
    CASE WHEN user_id % 3 = 0 THEN '["success"]' WHEN user_id % 3 = 1 THEN '{"pipeline_status": "failed", "pipeline_status_reason": "case ' || CAST(event_id AS VARCHAR) || '"}'
    ELSE '{"rows": 3}' END
    ELSE '{"pipeline_status": "success", "root": "/out/' || user_id || '", "files": {"/out/key": "note", "model": "/out/' || user_id || '/m' || event_id ||
    '.bin", "all": ["/out/' || user_id || '//a/./' || event_id || '", "/elsewhere/x", "say \\"/out/' || user_id || '/no\\"", "/out/' || user_id || '/a", "/out/' || user_id || '/f' || event_id % 7 || '/"]}}' END"""


def reports(spark, sf):
    e = table(spark, sf, "events")
    user, event = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    kind = F.col("event_type")
    failed = F.concat(F.lit('{"pipeline_status": "failed", "pipeline_status_reason": "case '), event, F.lit('"}'))
    good = F.concat(
        F.lit('{"pipeline_status": "success", "root": "/out/'), user, F.lit('", "files": {"/out/key": "note", "model": "/out/'), user,
        F.lit("/m"), event, F.lit('.bin", "all": ["/out/'), user, F.lit("//a/./"), event,
        F.lit('", "/elsewhere/x", "say \\"/out/'), user, F.lit('/no\\"", "/out/'), user, F.lit('/a", "/out/'), user,
        F.lit("/f"), (F.col("event_id") % 7).cast("string"), F.lit('/"]}}'),
    )
    report = (
        F.when(kind == "view", None)
        .when(kind == "click", '{"pipeline_status": "success", "model": ')
        .when((kind == "signup") & (F.col("user_id") % 3 == 0), '["success"]')
        .when((kind == "signup") & (F.col("user_id") % 3 == 1), failed)
        .when(kind == "signup", '{"rows": 3}')
        .otherwise(good)
    )
    return e.select(F.col("event_id").alias("run_id"), F.concat(F.lit("/out/"), user).alias("output_dir"), report.alias("report"), "value", "user_id")


def listing(spark, sf):
    e = table(spark, sf, "events")
    user, event = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    models = e.where("value > 20").select(F.concat(F.lit("/out/"), user, F.lit("/m"), event, F.lit(".bin")).alias("path"))
    plain = e.where("value > 40").select(F.concat(F.lit("/out/"), user, F.lit("/a/"), event).alias("path"))
    parts = e.where("value > 60").select(
        F.concat(F.lit("/out/"), user, F.lit("/f"), (F.col("event_id") % 7).cast("string"), F.lit("/part-0.parquet")).alias("path")
    )
    return models.unionByName(plain).unionByName(parts)


CLAIMS = f"""c AS (SELECT event_id AS run_id, unnest([json_extract_string(r, '$.files.model'), replace(json_extract_string(r, '$.files.all[0]'), '//a/./', '/a/'),
    json_extract_string(r, '$.files.all[3]'), rtrim(json_extract_string(r, '$.files.all[4]'), '/')]) AS path
    FROM (SELECT event_id, user_id, {REPORT} AS r, event_type FROM events) WHERE event_type IN ('purchase', 'error')),
    l AS (SELECT '/out/' || user_id || '/m' || event_id || '.bin' AS path FROM events WHERE value > 20
    UNION SELECT '/out/' || user_id || '/a/' || event_id FROM events WHERE value > 40
    UNION SELECT '/out/' || user_id || '/a' FROM events WHERE value > 40
    UNION SELECT '/out/' || user_id || '/f' || event_id % 7 FROM events WHERE value > 60)"""


@query("missing_artifacts", f"WITH {CLAIMS} SELECT run_id, path FROM c WHERE path NOT IN (SELECT path FROM l)")
def missing_artifacts(spark, sf):
    claims = D.artifact_claims(reports(spark, sf).select("run_id", "output_dir", "report"))
    return D.missing_artifacts(claims, listing(spark, sf))


@query(
    "report_validation",
    f"""WITH {CLAIMS}, m AS (SELECT run_id, string_agg(DISTINCT path, ', ' ORDER BY path) AS gap FROM c WHERE path NOT IN (SELECT path FROM l) GROUP BY 1),
    r AS (SELECT event_id AS run_id, {REPORT} AS r FROM events)
    SELECT run_id, CASE WHEN r IS NULL THEN 'missing' WHEN NOT json_valid(r) THEN 'invalid' WHEN json_type(r) <> 'OBJECT' THEN 'not_an_object'
    WHEN json_extract_string(r, '$.pipeline_status') = 'failed' THEN 'failed' WHEN gap IS NOT NULL THEN 'missing_artifact'
    WHEN json_extract_string(r, '$.pipeline_status') IS NULL THEN 'unknown' ELSE 'ok' END AS outcome,
    CASE WHEN NOT coalesce(json_valid(r), FALSE) THEN NULL WHEN json_extract_string(r, '$.pipeline_status') = 'failed' THEN json_extract_string(r, '$.pipeline_status_reason')
    ELSE gap END AS reason FROM r LEFT JOIN m USING (run_id)""",
)
def report_validation(spark, sf):
    r = reports(spark, sf)
    return D.validate_reports(r.select("run_id", "output_dir"), r.where("report is not null").select("run_id", "report"), listing(spark, sf))


TURNS = """(SELECT conv_id AS session_id, turn, CASE WHEN role = 'user' THEN '/data/' || length(text) || '.csv' END AS data_path,
    CASE WHEN length(text) % 2 = 0 THEN 'csv' END AS data_type, CASE length(text) % 3 WHEN 0 THEN 'regression' WHEN 1 THEN 'classification' END AS task_type,
    CASE WHEN length(text) > 400 THEN 'c' || turn END AS target_column, CASE WHEN turn = 0 THEN 'eda' END AS task_intent FROM conversations)"""


def turn_slots(conv):
    n = F.length("text")
    return conv.select(
        F.col("conv_id").alias("session_id"), "turn",
        F.when(F.col("role") == "user", F.concat(F.lit("/data/"), n.cast("string"), F.lit(".csv"))).alias("data_path"),
        F.when(n % 2 == 0, "csv").alias("data_type"),
        F.when(n % 3 == 0, "regression").when(n % 3 == 1, "classification").alias("task_type"),
        F.when(n > 400, F.concat(F.lit("c"), F.col("turn").cast("string"))).alias("target_column"),
        F.when(F.col("turn") == 0, "eda").alias("task_intent"),
    )


FOLD = f"""SELECT session_id, {', '.join(f'arg_max({s}, turn) FILTER (WHERE {s} IS NOT NULL) AS {s}' for s in S.SLOTS)} FROM {TURNS} GROUP BY 1"""


@query("slot_fold", FOLD)
def slot_fold(spark, sf):
    return S.fold_slots(turn_slots(table(spark, sf, "conversations")))


@query("slot_fold_stream", FOLD)
def slot_fold_stream(spark, sf):
    schema = table(spark, sf, "conversations").schema
    # As a pattern, so that the table can be one file or a folder of them; a stream takes no single file by its name.
    turns = turn_slots(spark.readStream.schema(schema).parquet(f"{sf}/[c]onversations.parquet"))
    out = scratch_path(spark, "fold")
    start_fold(turns, out, scratch_path(spark, "fold-state")).awaitTermination()
    return folded_sessions(spark, out, key_type=turns.schema["session_id"].dataType)


@query(
    "slot_extraction",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'data/order_' || o_orderkey || '.csv' WHEN 'P' THEN './in dir/my ' || o_custkey || '-file.parquet' END AS data_path,
    CASE o_orderstatus WHEN 'F' THEN 'csv' WHEN 'O' THEN 'csv' ELSE 'parquet' END AS data_type,
    CASE o_orderstatus WHEN 'F' THEN 'classification' WHEN 'O' THEN 'regression' ELSE 'clustering' END AS task_type,
    CASE o_orderstatus WHEN 'F' THEN 'col' || o_custkey WHEN 'O' THEN 'unit-price' ELSE 'fixed acidity - ' || o_custkey END AS target_column,
    CASE o_orderstatus WHEN 'O' THEN 'full_pipeline' WHEN 'P' THEN 'eda' END AS task_intent FROM orders""",
)
def slot_extraction(spark, sf):
    o = table(spark, sf, "orders")
    cust, order = F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")
    message = (
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("type of data is csv, target column is col"), cust, F.lit(" and task type is classification")))
        .when(F.col("o_orderstatus") == "O", F.concat(F.lit("data/order_"), order, F.lit(".csv, data is of type csv, regression and target column is unit-price, full pipeline")))
        .otherwise(F.concat(
            F.lit("- data_path: ./in dir/my "), cust, F.lit("-file.parquet\n- data_type: Parquet\n- task_type: Clustering, target_column: fixed acidity - "),
            cust, F.lit(" \n- task_intent: eda"),
        ))
    )
    return o.select("o_orderkey", *[c.alias(n) for n, c in T.extract_slots(message).items()])


@query(
    "merge_requests",
    f"""WITH {STAGE_TABLE}, q AS (SELECT session_id, unnest(list_concat(asked, ['edaagent', 'ModelTrainingAgent'])) AS name FROM {requested_sql()})
    SELECT DISTINCT session_id, coalesce(stage, name) AS stage FROM q LEFT JOIN s ON lower(name) = lower(stage)""",
)
def merge_requests(spark, sf):
    more = requests(spark, sf).withColumn("more", F.array(F.lit("edaagent"), F.lit("ModelTrainingAgent")))
    out = S.merge_requests(more, "agents_to_call", "more")
    return out.select("session_id", F.explode("agents_to_call").alias("stage"))


FENCED = """(SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN text ELSE text || chr(10) || '```python' || chr(10) || '  load(' || doc_id || ')' || chr(10) || text || chr(10)
    || '```' || chr(10) || 'or' || chr(10) || '```python' || chr(10) || lang || ' ```' || chr(10) || '```python open' END AS answer FROM documents)"""
BLOCKS = r"list_transform(regexp_extract_all(answer, '(?s)```python\s*(.*?)\s*```', 1), lambda b: regexp_replace(b, '^\s+|\s+$', '', 'g'))"


def answers(spark, sf):
    d = table(spark, sf, "documents")
    fenced = F.concat(
        F.col("text"), F.lit("\n```python\n  load("), F.col("doc_id").cast("string"), F.lit(")\n"), F.col("text"),
        F.lit("\n```\nor\n```python\n"), F.col("lang"), F.lit(" ```\n```python open"),
    )
    return d.select("doc_id", F.when(F.col("n_chars") % 3 == 0, F.col("text")).otherwise(fenced).alias("answer"))


@query(
    "code_blocks",
    f"""SELECT doc_id, CAST(pos AS INTEGER) - 1 AS pos, b[pos] AS code FROM (SELECT doc_id, b, unnest(range(1, len(b) + 1)) AS pos
    FROM (SELECT doc_id, {BLOCKS} AS b FROM {FENCED}))""",
)
def code_blocks(spark, sf):
    return answers(spark, sf).select("doc_id", F.posexplode(T.python_blocks(F.col("answer"))).alias("pos", "code"))


@query("first_code_block", f"SELECT doc_id, b[1] AS code, coalesce(b[1], '') <> '' AS is_valid FROM (SELECT doc_id, {BLOCKS} AS b FROM {FENCED})")
def first_code_block(spark, sf):
    out = answers(spark, sf).select("doc_id", T.first_block(F.col("answer")).alias("code"))
    return out.withColumn("is_valid", F.coalesce(F.col("code") != "", F.lit(False)))


@query(
    "json_fence",
    """SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, event_type <> 'error' AS is_valid FROM events""",
)
def json_fence(spark, sf):
    e = table(spark, sf, "events")
    answer = F.concat(
        F.lit("```json\n"), F.when(F.col("event_type") == "error", F.replace("props", F.lit("}"), F.lit(","))).otherwise(F.col("props")), F.lit(" \n```\n")
    )
    bare = e.select("event_id", T.strip_json_fence(F.when(F.col("event_type") == "view", F.col("props")).otherwise(answer)).alias("value"))
    return readers.parse_documents(bare, "value", "k long").select("event_id", "doc.k", "is_valid")


PLAN = """CASE event_type WHEN 'view' THEN '["load ' || event_id || '", "profile"]' WHEN 'click' THEN '[]' WHEN 'error' THEN '[' || event_id || ', "x"]'
    WHEN 'purchase' THEN '{"task": ' || event_id || '}' ELSE 'load, then profile' END"""


@query(
    "plan_validation",
    f"""WITH p AS (SELECT event_id, {PLAN} AS plan FROM events) SELECT event_id,
    CASE WHEN json_valid(plan) AND json_structure(plan) = '["VARCHAR"]' THEN array_to_string(CAST(json(plan) AS VARCHAR[]), '|') END AS tasks,
    CASE WHEN NOT json_valid(plan) THEN 'not valid JSON' WHEN json_type(plan) <> 'ARRAY' THEN 'not a list'
    WHEN json_array_length(plan) = 0 THEN 'empty list' WHEN json_structure(plan) <> '["VARCHAR"]' THEN 'not a list of strings' END AS reason FROM p""",
)
def plan_validation(spark, sf):
    e = table(spark, sf, "events")
    event, kind = F.col("event_id").cast("string"), F.col("event_type")
    plan = (
        F.when(kind == "view", F.concat(F.lit('["load '), event, F.lit('", "profile"]'))).when(kind == "click", "[]")
        .when(kind == "error", F.concat(F.lit("["), event, F.lit(', "x"]')))
        .when(kind == "purchase", F.concat(F.lit('{"task": '), event, F.lit("}"))).otherwise("load, then profile")
    )
    out = D.validate_plans(e.select("event_id", plan.alias("plan")))
    return out.select("event_id", F.array_join("tasks", "|").alias("tasks"), "reason")


@query(
    "bounded_text",
    """SELECT doc_id, CASE WHEN length(text) > 300 THEN left(text, 300) || '... [truncated, ' || length(text) || ' chars total]' ELSE text END AS rendered
    FROM documents""",
)
def bounded_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", bounded.cut_text(F.col("text")).alias("rendered"))


@query(
    "bounded_render",
    """WITH w AS (SELECT doc_id, lang, string_split(text, ' ') AS words, text FROM documents),
    c AS (SELECT doc_id, to_json({'doc_id': doc_id, 'lang': lang,
    'words': list_concat(list_transform(words[1:15], lambda x: CASE WHEN length(x) > 300 THEN left(x, 300) || '... [truncated, ' || length(x) || ' chars total]' ELSE x END),
      CASE WHEN len(words) > 15 THEN ['... ' || (len(words) - 15) || ' more items omitted'] ELSE [] END),
    'text': CASE WHEN length(text) > 300 THEN left(text, 300) || '... [truncated, ' || length(text) || ' chars total]' ELSE text END}) AS t FROM w)
    SELECT doc_id, CASE WHEN length(t) > 6000 THEN left(t, 6000) || chr(10) || '... [truncated, ' || length(t) || ' chars total]' ELSE CAST(t AS VARCHAR) END AS rendered,
    length(t) > 6000 AS is_truncated FROM c""",
)
def bounded_render(spark, sf):
    d = table(spark, sf, "documents")
    packed = d.select(
        "doc_id", F.struct("doc_id", "lang", F.split("text", " ").alias("words"), "text").alias("report")
    )
    return bounded.render(packed, "report").drop("report")


@query(
    "upstream_context",
    """WITH i AS (SELECT c_custkey AS session_id, 'i' || c_name AS info FROM customer WHERE c_acctbal > 0),
    e AS (SELECT o_custkey AS session_id, 'e' || max(o_orderkey) AS eda FROM orders GROUP BY 1),
    f AS (SELECT o_custkey AS session_id, 'f' || min(o_orderkey) AS features FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
    SELECT session_id, info, eda, features, CASE WHEN info IS NULL THEN 'info' WHEN eda IS NULL THEN 'eda' END AS missing_input
    FROM i FULL JOIN e USING (session_id) LEFT JOIN f USING (session_id)""",
)
def upstream_context(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    tag = lambda t, x: F.concat(F.lit(t), x.cast("string")).alias("report")
    by = F.col("o_custkey").alias("session_id")
    return D.upstream_context(
        c.where("c_acctbal > 0").select(F.col("c_custkey").alias("session_id"), tag("i", F.col("c_name"))),
        o.groupBy(by).agg(tag("e", F.max("o_orderkey"))),
        o.where("o_orderstatus = 'F'").groupBy(by).agg(tag("f", F.min("o_orderkey"))),
    )


def run_outcome(results):
    """The candidates of a run's leaderboard, and whether each was ranked."""
    return results.leaderboard.select("task", "model", "metric", F.col("rank").isNotNull().alias("is_ranked"))


def run_sql(task: str, metric: str, models: str) -> str:
    names = ", ".join(f"('{m}')" for m in models.split())
    return f"SELECT '{task}' AS task, model, '{metric}' AS metric, TRUE AS is_ranked FROM (VALUES {names}) AS t(model)"


@query("run_classification", run_sql("classification", "accuracy", "constant logistic_regression decision_tree random_forest"))
def run_classification(spark, sf):
    """All three stages on `customer`, from the path in a task record to the ranked models."""
    info = {
        "data_path": "customer.parquet", "task_type": "classification", "target_column": "c_mktsegment",
        "agents_to_call": ["ModelTrainingAgent"],
    }
    return run_outcome(run(spark, info, scratch_path(spark, "run"), base=sf, partitions=spark.sparkContext.defaultParallelism))


@query(
    "run_regression",
    run_sql(
        "regression", "rmse",
        "constant linear_regression ridge lasso decision_tree random_forest gradient_boosted_trees generalized_linear",
    ),
)
def run_regression(spark, sf):
    """All three stages on `lineitem`, predicting the price."""
    info = {
        "data_path": "lineitem.parquet", "target_column": "l_extendedprice", "agents_to_call": ["EdaAgent", "ModelTrainingAgent"],
    }
    return run_outcome(run(spark, info, scratch_path(spark, "run"), base=sf, partitions=spark.sparkContext.defaultParallelism))
