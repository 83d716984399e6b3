"""Readers, sinks, streams and whole file-to-table runs, on files written from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.html import add_html_text
from millrace.plans.config import CleanerConfig
from millrace.plans.fit import fit
from millrace.plans.flow import run_workflow
from millrace.session import files_for, input_bytes, scratch_path, spread
from millrace.sources.readers import read_any, read_catalog
from millrace.sources.sinks import save_table, write_csv
from millrace.sources.xml_nodes import inside, read_xml_nodes
from millrace.streaming import keyed
from millrace.streaming.landing import clean_stream, read_landing, write_landing
from queries import written
from queries.base import DIRTY_DUCK, DUP_DUCK, dirty_orders, dup_events, table
from queries.cleaning import ORACLES as CLEANING_SQL


def _customers(spark, d):
    return table(spark, d, "customer")


def _documents(spark, d):
    return table(spark, d, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"), "text"
    )


# ---- readers ----


def read_csv(spark, d):
    path = write_csv(_customers(spark, d), scratch_path(spark, "csv"))
    return read_any(spark, path, "csv")


def read_csv_texts(spark, d):
    """Texts with quotes, commas and line breaks survive."""
    df = table(spark, d, "documents").select("doc_id", "text")
    path = write_csv(df, scratch_path(spark, "csv"))
    back = read_any(
        spark, path, "csv", schema="doc_id bigint, text string", multiLine=True, lineSep="\n"
    )
    return back.select("doc_id", F.md5("text").alias("digest"))


def read_tsv(spark, d):
    path = scratch_path(spark, "tsv")
    _customers(spark, d).write.option("header", True).option("sep", "\t").csv(path)
    return read_any(spark, path, "tsv")


def read_json_lines(spark, d):
    path = scratch_path(spark, "json")
    _customers(spark, d).write.json(path)
    return read_any(spark, path, "jsonl")


def read_json_documents(spark, d):
    """Arrays of whole rows, one JSON array per file and task, as a whole-document reader expects."""
    folder = written.json_files(_customers(spark, d))
    return read_any(spark, folder, "json", schema=_customers(spark, d).schema)


FILE_BYTES = 256 << 20
XML_RECORDS = 20_000


def _in_few(df):
    """One large file's worth of rows per partition: a single one up to FILE_BYTES of input, else as many as it takes."""
    return df.coalesce(files_for(input_bytes(df), FILE_BYTES))


def read_csv_one_file(spark, d):
    """All documents from one CSV file (beyond FILE_BYTES: a few) with line breaks in its values, cut at the true ends of records."""
    df = table(spark, d, "documents")
    path = write_csv(_in_few(df), scratch_path(spark, "csv"))
    back = read_any(spark, path, "csv", schema=df.schema, multiLine=True, parallel=True)
    return back.withColumn("text", F.md5("text"))


def read_json_one_file(spark, d):
    """All documents from large JSON arrays, cut at the true ends of records, the schema inferred."""
    folder = written.json_files(_in_few(table(spark, d, "documents")))
    return read_any(spark, folder, "json", parallel=True).withColumn("text", F.md5("text"))


def _write_xml(customers, path):
    """Files of bounded length, for an XML file is read by one task."""
    writer = customers.write.format("xml").option("maxRecordsPerFile", XML_RECORDS)
    writer.option("rowTag", "customer").option("rootTag", "all").save(path)


def xml_subtrees(spark, d):
    """Orders nested in customers, written as XML and read as nodes: what lies inside each customer."""
    path = scratch_path(spark, "nested-xml")
    orders = table(spark, d, "orders").selectExpr("o_custkey", "struct(o_orderkey as _key, o_orderstatus as status, o_totalprice as price) as o")
    held = orders.groupBy("o_custkey").agg(F.collect_list("o").alias("order"))
    customers = table(spark, d, "customer").join(held, F.col("c_custkey") == F.col("o_custkey"), "left")
    customers = customers.selectExpr("c_custkey as _id", "c_name as name", "`order`")
    _write_xml(customers, path)
    nodes = read_xml_nodes(spark, path)
    found = inside(nodes, nodes.where("tag = 'customer'").select("doc", "pre", "attributes"))
    return found.groupBy(F.col("top_attributes")["id"].cast("long").alias("c_custkey")).agg(
        F.max(F.when(F.col("tag") == "name", F.col("text"))).alias("name"),
        F.count_if(F.col("tag") == "order").alias("orders"),
        F.max(F.when(F.col("tag") == "order", F.col("attributes")["key"].cast("long"))).alias("last_key"),
        F.round(F.sum(F.when(F.col("path") == "/all/customer/order/price", F.col("text").cast("double"))), 2).alias("price"),
    )


def read_xml(spark, d):
    path = scratch_path(spark, "xml")
    customers = _customers(spark, d)
    _write_xml(customers, path)
    return read_any(spark, path, "xml", row_tag="customer", schema=customers.schema)


def read_parquet(spark, d):
    return read_any(spark, f"{d}/nation.parquet")


def read_feather(spark, d):
    return read_any(spark, written.feather_files(_customers(spark, d)), "feather")


def read_gzip(spark, d):
    folder = written.gzip_files(_documents(spark, d))
    return _members(read_any(spark, folder, "gz"), F.regexp_extract("path", r"(doc-\d+)", 1))


def read_gzip_csv(spark, d):
    path = scratch_path(spark, "csvgz")
    _customers(spark, d).write.option("header", True).option("compression", "gzip").csv(path)
    return read_any(spark, path + "/*.csv.gz")


def _members(df, name):
    return df.select(name.alias("name"), F.md5("text").alias("digest"))


def read_zip(spark, d):
    return _members(read_any(spark, written.zip_files(_documents(spark, d)), "zip"), F.col("member"))


def read_tar(spark, d):
    return _members(read_any(spark, written.tar_files(_documents(spark, d)), "tar"), F.col("member"))


def read_text(spark, d):
    """Whole files, one per document."""
    folder = written.text_files(_documents(spark, d))
    return _members(read_any(spark, folder, "txt"), F.regexp_extract("path", r"(doc-\d+)", 1))


def read_text_lines(spark, d):
    folder = scratch_path(spark, "text")
    table(spark, d, "customer").select("c_name").write.text(folder)
    return read_any(spark, folder, "txt", whole=False).select("text")


def read_feather_mixed(spark, d):
    """Files of which half lack a column and hold another one."""
    customers = _customers(spark, d)
    odd = customers.where("c_custkey % 2 = 1").drop("c_acctbal").withColumn("extra", F.col("c_custkey") + 1)
    written.feather_files(odd, folder := scratch_path(spark, "feather"))
    written.feather_files(customers.where("c_custkey % 2 = 0"), folder)
    return read_any(spark, folder, "feather")


def read_csv_corrupt(spark, d):
    """Lines with a surplus field are kept whole, and all other lines are read."""
    rows = _customers(spark, d).select(
        F.concat_ws(",", "c_custkey", "c_mktsegment", F.when(F.col("c_custkey") % 10 == 0, F.lit("surplus"))).alias("value")
    )
    rows.write.text(path := scratch_path(spark, "csv"))
    back = read_any(
        spark, path, "csv", schema="c_custkey bigint, c_mktsegment string", keep_damaged="damaged", header=False
    )
    return back.select(
        F.coalesce("c_custkey", F.element_at(F.split("damaged", ","), 1).cast("bigint")).alias("c_custkey"), "damaged"
    )


def read_mail(spark, d):
    mails = table(spark, d, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("name"),
        F.concat(F.lit("Turn "), F.col("turn").cast("string")).alias("subject"),
        F.concat(F.col("role"), F.lit("@example.org")).alias("sender"),
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("@example.org")).alias("recipient"),
        "text",
        F.col("text").alias("body"),
        F.when(F.col("turn") % 2 == 0, F.concat(F.lit("<p>Zürich "), "role", F.lit("</p>"))).alias("html"),
    )
    back = read_any(spark, written.mail_files(mails), "eml")
    flat = F.trim(F.regexp_replace("body", r"\s+", " "))
    return back.select("subject", "sender", "recipient", F.md5(flat).alias("digest"))


def html_text(spark, d):
    out = add_html_text(spread(table(spark, d, "pages").select("page_id", "html")), "html")
    return out.select("page_id", F.length("text").cast("bigint").alias("n"), F.md5("text").alias("digest"))


# ---- sinks ----


def stored_table(spark, d):
    path = scratch_path(spark, "table")
    name = save_table(_customers(spark, d), "stored_customers", path)
    return read_catalog(spark, [name])[name]


def bucketed_join(spark, d):
    """Two tables bucketed on the join key: the join needs no shuffle."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        save_table(
            table(spark, d, name), f"bucketed_{name}", scratch_path(spark, name), cluster_by=(buckets, (key,))
        )
    orders, lines = spark.table("bucketed_orders"), spark.table("bucketed_lineitem")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity")
    )


def html_attributes(spark, d):
    """Known parts of a page around the text, markup signs inside attributes and an open comment."""
    pages = table(spark, d, "pages").select("page_id", "url")
    page = F.concat(
        F.lit("<html><body><a title=\"x>y\" href='q>'>link "), F.col("page_id").cast("string"),
        F.lit("</a><script data-x=\"</b>\">var a = '<p>';</script> of <b class='>'>"), "url",
        F.lit("</b> 1 < 2 <img alt=\"open>rest<!-- never closed <p>lost</p>"),
    )
    out = add_html_text(pages.select("page_id", page.alias("html")), "html")
    return out.select("page_id", "text")


def csv_sink(spark, d):
    path = write_csv(dirty_orders(spark, d), scratch_path(spark, "csv"))
    kinds = "o_orderkey bigint, status_raw string, price_usd string, pct string, flag string, " \
        "compound string, price double"
    return read_any(
        spark, path, "csv", schema=kinds, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


# ---- streams and whole runs ----


def stream_clean(spark, d):
    """A fitted plan applied to event files as they arrive, then read back."""
    events = table(spark, d, "events")
    landing, out = scratch_path(spark, "landing"), scratch_path(spark, "cleaned")
    events.repartition(spark.sparkContext.defaultParallelism).write.parquet(landing)
    plan = fit(events, CleanerConfig())
    for _ in range(2):  # the second run finds nothing new and adds nothing
        write_landing(clean_stream(read_landing(spark, landing, plan), plan), out).awaitTermination()
    done = spark.read.parquet(out)
    return done.select(
        *(F.round(c, 4).alias(c) for c in ("event_id", "user_id", "value", "props__k")), "ts", "event_type",
        "value_is_outlier",
    )


def _keyed_runs(spark, parts, keys, order, late_by, keep_ms):
    """The parts land one after the other; each is a run of its own that goes on from the checkpoint."""
    landing, out, state = (scratch_path(spark, x) for x in ("landing", "first", "state"))
    schema = parts[0].schema
    for part in parts:
        part.repartition(spark.sparkContext.defaultParallelism).write.mode("append").parquet(landing)
        with keyed.keyed_state(spark):
            stream = spark.readStream.schema(schema).parquet(landing)
            first = keyed.first_by_key(stream, keys, order, "ts", late_by, keep_ms)
            keyed.write_keyed(first, out, state).awaitTermination()
    done = scratch_path(spark, "keyed")
    keyed.keyed_table(spark, out, state, schema).write.parquet(done)
    return spark.read.parquet(done)


def stream_first_by_key(spark, d):
    """The greatest value per user and kind, from files that hold the events in no order of time."""
    events = dup_events(spark, d).select("event_id", "user_id", "event_type", "value", "ts")
    parts = [events.where(f"event_id % 3 {sign} 0") for sign in ("=", "<>")]
    return _keyed_runs(spark, parts, ["user_id", "event_type"], [-F.col("value")], "400 days", 1000).drop("late")


def stream_late_rows(spark, d):
    """Copies and further events arrive after others; what is older than ten days by then is told apart."""
    events = table(spark, d, "events").select("event_id", "user_id", "value", "ts")
    parts = [events.where(f"event_id % {n} = 0") for n in (2, 3)]
    return _keyed_runs(spark, parts, ["event_id"], ["value"], "10 days", 86_400_000)


def _stored_orders(spark, d):
    path = scratch_path(spark, "dirty_orders")
    dirty_orders(spark, d).write.parquet(path)
    return path


def file_to_table(spark, d):
    """Read, clean, store and analyse; the stored table is returned."""
    run = run_workflow(
        spark, _stored_orders(spark, d), fmt="parquet", table="cleaned_orders",
        table_path=scratch_path(spark, "stored"),
    )
    if run.status != "success":
        raise RuntimeError(run.error)
    doubles = [f.name for f in run.cleaned.schema.fields if f.dataType.simpleString() == "double"]
    return run.cleaned.withColumns({c: F.round(c, 4) for c in doubles})


def file_to_answer(spark, d):
    """The same with a question at the end."""
    run = run_workflow(
        spark, _stored_orders(spark, d), fmt="parquet", table="asked_orders",
        table_path=scratch_path(spark, "stored"), question="How many orders per status?",
        translate=lambda _: "SELECT status_raw, count(*) AS n FROM asked_orders GROUP BY status_raw;",
    )
    if run.status != "success":
        raise RuntimeError(run.error)
    return run.answer


QUERIES = {
    f.__name__: f
    for f in (
        read_csv,
        read_csv_texts,
        read_csv_one_file,
        read_json_one_file,
        read_tsv,
        read_json_lines,
        read_json_documents,
        read_xml,
        xml_subtrees,
        read_parquet,
        read_feather,
        read_gzip,
        read_gzip_csv,
        read_zip,
        read_tar,
        read_text,
        read_text_lines,
        read_feather_mixed,
        read_csv_corrupt,
        read_mail,
        html_text,
        html_attributes,
        stored_table,
        bucketed_join,
        csv_sink,
        stream_clean,
        stream_first_by_key,
        stream_late_rows,
        file_to_table,
        file_to_answer,
    )
}

_CUSTOMERS = "select * from customer"
_DIGESTS = "select concat('doc-', cast(doc_id as varchar)) as name, md5(text) as digest from documents"

_HTML = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
for _name in ("script", "style", "template", "rt", "rp"):
    _HTML = f"regexp_replace({_HTML}, '(?is)<{_name}\\b[^>]*>.*?</{_name}\\s*>', '', 'g')"
_HTML = f"regexp_replace({_HTML}, '<![^>]*>|<\\?[^>]*>|</?[A-Za-z][^>]*>', '', 'g')"
for _entity, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
    _HTML = f"replace({_HTML}, '{_entity}', '{_char}')"


ORACLES = {
    "read_csv": _CUSTOMERS.replace("*", "* replace (c_custkey::int as c_custkey)"),
    "read_csv_texts": "select doc_id, md5(text) as digest from documents",
    "read_csv_one_file": "select * replace (md5(text) as text) from documents",
    "read_json_one_file": "select * replace (md5(text) as text) from documents",
    "read_tsv": _CUSTOMERS.replace("*", "* replace (c_custkey::int as c_custkey)"),
    "read_json_lines": _CUSTOMERS.replace("*", "* replace (c_nationkey::bigint as c_nationkey)"),
    "read_json_documents": _CUSTOMERS,
    "read_xml": _CUSTOMERS,
    "xml_subtrees": """
select c_custkey, c_name as name, count(o_orderkey) as orders, max(o_orderkey) as last_key, round(sum(o_totalprice), 2) as price
from customer left join orders on c_custkey = o_custkey group by c_custkey, c_name""",
    "read_parquet": "select * from nation",
    "read_feather": _CUSTOMERS,
    "read_gzip": _DIGESTS,
    "read_gzip_csv": _CUSTOMERS.replace("*", "* replace (c_custkey::int as c_custkey)"),
    "read_zip": _DIGESTS,
    "read_tar": _DIGESTS,
    "read_text": _DIGESTS,
    "read_text_lines": "select c_name as text from customer",
    "read_feather_mixed": """
select c_custkey, c_name, c_nationkey, c_mktsegment, case when c_custkey % 2 = 0 then c_acctbal end as c_acctbal,
  case when c_custkey % 2 = 1 then c_custkey + 1 end as extra from customer""",
    "read_csv_corrupt": """
select c_custkey, case when c_custkey % 10 = 0 then concat(c_custkey, ',', c_mktsegment, ',surplus') end as damaged
from customer""",
    "html_attributes": """
select page_id, concat('link ', page_id, ' of ', url, ' 1 < 2 rest') as text from pages""",
    "read_mail": """
select concat('Turn ', cast(turn as varchar)) as subject, concat(role, '@example.org') as sender,
  concat('c', cast(conv_id as varchar), '@example.org') as recipient,
  md5(trim(regexp_replace(concat(text, case when turn % 2 = 0 then concat(' <p>Zürich ', role, '</p>') else '' end),
    '\\s+', ' ', 'g'))) as digest from conversations""",
    "html_text": f"select page_id, length(t) as n, md5(t) as digest from (select page_id, {_HTML} as t from pages)",
    "stored_table": _CUSTOMERS,
    "bucketed_join": """
select o_orderstatus, count(*) as n, round(sum(l_quantity), 2) as quantity
from lineitem join orders on l_orderkey = o_orderkey group by o_orderstatus""",
    "csv_sink": f"select * from {DIRTY_DUCK}",
    "stream_clean": """
with t as (select event_id::double as event_id, user_id::double as user_id, value, ts, event_type,
    cast(json_extract(props, '$.k') as double) as props__k from events),
q as (select quantile_cont(event_id, 0.01) as a1, quantile_cont(event_id, 0.99) as a2,
  quantile_cont(user_id, 0.01) as u1, quantile_cont(user_id, 0.99) as u2,
  quantile_cont(value, 0.01) as b1, quantile_cont(value, 0.99) as b2,
  quantile_cont(props__k, 0.01) as c1, quantile_cont(props__k, 0.99) as c2 from t),
l as (select greatest(least(event_id, a2), a1) as event_id, greatest(least(user_id, u2), u1) as user_id, ts, event_type,
  greatest(least(value, b2), b1) as value, greatest(least(props__k, c2), c1) as props__k from t, q)
select round(event_id, 4) as event_id, round(user_id, 4) as user_id, round(value, 4) as value,
  round(props__k, 4) as props__k, ts, event_type,
  abs(value - avg(value) over ()) > 3 * stddev_pop(value) over () as value_is_outlier from l""",
    "stream_first_by_key": f"""
select event_id, user_id, event_type, value, ts from (select *, row_number() over (
  partition by user_id, event_type order by value desc, event_id) as rn from {DUP_DUCK}) where rn = 1""",
    "stream_late_rows": """
with w as (select epoch_ms(max(ts)) - 864000000 as w from events where event_id % 2 = 0)
select event_id, user_id, value, ts, false as late from events where event_id % 2 = 0
union all
select event_id, user_id, value, ts, epoch_ms(ts) <= w as late from events, w
where event_id % 3 = 0 and (event_id % 2 = 1 or epoch_ms(ts) <= w)""",
    "file_to_table": CLEANING_SQL["clean_table"],
    "file_to_answer": f"""
select case when o_orderkey % 11 in (0, 2) then 'unknown' when o_orderkey % 11 = 1 then 'n/a'
  else lower(concat(o_orderstatus, ' x')) end as status_raw, count(*) as n
from orders group by 1""",
}
