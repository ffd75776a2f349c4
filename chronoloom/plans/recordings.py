"""Queries on recordings, EDF and text files made of the driver's tables: what is written and read again equals what
SQL says of the tables. The files are made when a query is called, in the folder that the cluster shares."""

from __future__ import annotations

import os
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.functions import layout
from chronoloom.functions import signal as sig
from chronoloom.functions.timeutil import local_start, micros, micros_of_ticks, ticks_of_text
from chronoloom.operators import compare, digests, frames
from chronoloom.plans import convert
from chronoloom.plans.catalog import FR, HOUR, PAD, E, events, frame_table, query
from chronoloom.sources import edf, recording, scratch, synthetic, tables, texts
from chronoloom.streaming import live

#: Events as one recording: hours are frames, event types are inputs, rounded values are units.
UNITS = E + "o as (select min(frame_no) as origin from e), t as (select event_type, row_number() over (order by event_type) as amp from (select distinct event_type from e)), u as (select frame_no - origin as frame_no, amp::int as amp_input, round(value)::bigint as v, us, event_id from e join t using (event_type), o), "
STAMP = "strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S.%f')"


def text_of(us) -> F.Column:
    """A time stamp of the index, with seven digits of a second."""
    at = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=us / F.lit(1000000).cast("decimal(20,6)"))
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0"))


def units(spark, sf) -> DataFrame:
    e = events(spark, sf)
    kinds = e.select("event_type").distinct().select("event_type", F.row_number().over(W.orderBy("event_type")).alias("amp_input"))  # five rows
    origin = e.agg(F.min("frame_no").alias("origin"))
    return e.join(F.broadcast(kinds), "event_type").crossJoin(F.broadcast(origin)).select((F.col("frame_no") - F.col("origin")).alias("frame_no"), "amp_input", F.round("value").cast("long").alias("v"), "us", "event_id")


def made(spark, sf, notes: DataFrame | None = None, **more) -> str:
    u = units(spark, sf)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("us", "event_id", "v"))), lambda x: x["v"])
    f = u.groupBy("frame_no", "amp_input").agg(ordered.alias("units"))
    clock = u.groupBy("frame_no").agg((F.min("us") * 10).alias("start_ticks"), (F.max("us") * 10 + 10).alias("end_ticks"), text_of(F.min("us")).alias("ts"))
    f = f.join(clock, "frame_no").withColumn("rate", F.lit(50))
    return synthetic.write_recording(f, scratch.folder(spark, "recording"), events=notes, **more)


FRAMES_SQL = UNITS + f"x as (select 1) select frame_no, amp_input, count(*) as n, round(arg_min(v, (us, event_id)) * {sig.UNIT_UV}::double, 4) as first, round(sum(v)::double * {sig.UNIT_UV}::double, 3) as total from u group by all"


@query(FRAMES_SQL)
def recording_frames(spark, sf):
    f = recording.frames(spark, made(spark, sf))
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    return f.select("frame_no", "amp_input", F.size("samples").cast("long").alias("n"), F.round(F.get("samples", F.lit(0)), 4).alias("first"), F.round(total, 3).alias("total"))


@query(FRAMES_SQL)
def sql_frame_decode(spark, sf):
    # SQL text alone: the database's tables as views, and frames decoded by a table function
    tables.register(spark)
    tables.recording_views(spark, made(spark, sf), "rec")
    return spark.sql("""
        select i.Offset as frame_no, d.amp_input, cast(size(d.samples) as bigint) as n, round(d.samples[0], 4) as first,
               round(aggregate(d.samples, cast(0 as double), (total, x) -> total + x), 3) as total
        from rec_FrameInfo i join rec_FrameData b on i.FrameKey = b.FrameKey, lateral frame_decode(b.Data) d
        where i.Track = 0""")


@query(UNITS + f"f as (select amp_input, frame_no, count(*) as n, round(sum(v)::double * {sig.UNIT_UV}::double, 3) as total from u group by all), g as (select *, coalesce(frame_no - lag(frame_no) over w - 1, 0) as missing from f window w as (partition by amp_input order by frame_no)) select amp_input, frame_no, missing, n, total, (sum(n + {PAD} * missing) over w - n)::bigint as first_sample, (sum((missing > 0)::int) over w)::int as segment from g window w as (partition by amp_input order by frame_no rows unbounded preceding)")
def live_placement(spark, sf):
    """The recording read as a stream, in one batch; each input's frames in order, as they are placed."""
    path, out = made(spark, sf), scratch.folder(spark, "stream")
    stream = live.live_frames(spark, [path], pad=PAD, highpass=False).select("amp_input", "frame_no", "kind", "missing", "first_sample", "segment", F.size("samples").cast("long").alias("n"), F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x), 3).alias("total"))
    writing = stream.writeStream.format("parquet").option("checkpointLocation", f"file://{out}/checkpoint").trigger(availableNow=True)
    writing.start(f"file://{out}/frames").awaitTermination()
    return spark.read.parquet(f"file://{out}/frames").where("kind = 'frame'").drop("kind")


@query(UNITS + "x as (select frame_no, min(us) as us from u group by all) select frame_no, us * 10 as ticks, us from x")
def recording_index(spark, sf):
    index = recording.index(spark, os.path.dirname(made(spark, sf)))
    ticks = ticks_of_text(F.col("ts"))
    return index.select("frame_no", ticks.alias("ticks"), micros_of_ticks(ticks).alias("us"))


@query(UNITS + "x as (select distinct frame_no from u), p as (select frame_no, pmod from (select frame_no, frame_no % 4 as pmod from x)) select 0 as track, count(*) as frames, min(frame_no) as first, max(frame_no) as last, (max(frame_no) - min(frame_no) + 1 - count(*))::bigint as missing, count(distinct pmod)::int as files, true as present from p")
def recording_inventory(spark, sf):
    path = made(spark, sf)
    present = recording.data_files(spark, path).agg(F.bool_and("present").alias("present"))
    found = recording.inventory(spark, path).crossJoin(F.broadcast(present))
    return found.select(F.col("Track").alias("track"), "frames", "first", "last", "missing", F.size("files").alias("files"), "present")


@query("with e as (select epoch_us(ts) as us, event_id from events), x as (select min(us) as a, max(us) as b, count(*) as n, '2.' || min(event_id) as version from e) select version, case n % 3 when 0 then 5 when 1 then 1 else 9 end::int as amp_type, case n % 3 when 0 then 'Apollo' else 'Essentia' end as headbox, n % 3 < 2 as known, (a - b)::bigint as correction from x")
def recording_header(spark, sf):
    # the amplifier, the version and the clocks' first comparison are what the events say
    e = events(spark, sf)
    said = e.agg(F.count("*").alias("n"), F.min("event_id").alias("first"), text_of(F.min("us")).alias("a"), text_of(F.max("us")).alias("b")).first()
    path = made(spark, sf, version=f"2.{said.first}", kind=(5, 1, 9)[said.n % 3], correction=(said.a, said.b))
    index = spark.createDataFrame([(0, path)], "rec int, file string")
    facts = convert.of_index(spark, index, [path]).join(F.broadcast(layout.headboxes(spark)), "amp_type", "left")
    return facts.select("version", "amp_type", F.coalesce("headbox", F.lit(layout.HEADBOXES[layout.DEFAULT][0])).alias("headbox"), F.col("headbox").isNotNull().alias("known"), "correction")


@query(E + "x as (select *, us * 10 as ticks from e) select ticks, event_type as kind, 'note ' || event_id as text, event_id % 10 = 0 as deleted from x")
def recording_events(spark, sf):
    e = events(spark, sf)
    stamp, ticks = text_of(F.col("us")), F.col("us") * 10
    notes = e.select(F.col("event_type").alias("EventType"), F.concat(F.lit("note "), F.col("event_id").cast("string")).alias("Text"), stamp.alias("StartTime"), stamp.alias("EndTime"), ticks.alias("StartOffset"), ticks.alias("EndOffset"), F.when(F.col("event_id") % 10 == 0, 1).alias("Deleted"), F.lit(0).alias("Priority"))
    found = recording.recorded_events(spark, made(spark, sf, notes))
    return found.select(ticks_of_text(F.col("StartTime")).alias("ticks"), F.col("EventType").alias("kind"), F.col("Text").alias("text"), "deleted")


ENDS = [-1000.0, 1000.0, -32768.0, 32767.0]
SIGNALS = [{"label": f"EEG {x}-Cz", "unit": "uV", "pmin": -1000, "pmax": 1000, "dmin": -32768, "dmax": 32767, "samples": 50} for x in ("A", "B")]
DIGITAL = "with r as (select *, row_number() over (order by event_id) - 1 as p from events), d as (select p, event_id, event_type, least(greatest(round_even((value - -1000.0) / (1000.0 - -1000.0) * (32767.0 - -32768.0) + -32768.0, 0), -32768.0), 32767.0)::int as d from r), w as (select p // 100 as record, (p % 100) // 50 as signal_no, p % 50 as k, d from d where p < (select count(*) // 100 * 100 from r)) "


def numbered(spark, sf) -> DataFrame:
    """event_id, event_type and value with p, each event's number in the order of ids: counted in ranges of ids."""
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("part", F.floor(F.col("event_id") / 4096))
    sizes = e.groupBy("part").agg(F.count("*").alias("k"))
    before = sizes.select("part", (F.sum("k").over(W.orderBy("part")) - F.col("k")).alias("before"))
    inside = F.row_number().over(W.partitionBy("part").orderBy("event_id"))
    return e.withColumn("i", inside).join(before, "part").select("event_id", "event_type", "value", (F.col("before") + F.col("i") - 1).alias("p"))


def whole_records(spark, sf) -> DataFrame:
    """record, signal_no and digital of as many whole records of two signals as the events make."""
    r = numbered(spark, sf)
    whole = r.agg(F.expr("count(*) div 100 * 100").alias("whole"))
    d = r.crossJoin(F.broadcast(whole)).where("p < whole").select(F.expr("p div 100").alias("record"), F.expr("cast(p % 100 div 50 as int)").alias("signal_no"), "p", sig.quantised(F.col("value"), *map(F.lit, ENDS)).alias("d"))
    return d.groupBy("record", "signal_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "d"))), lambda x: x["d"]).alias("digital"))


def notes_of(spark, sf) -> DataFrame:
    r = numbered(spark, sf).where("event_type = 'purchase'")
    return r.select((F.col("p") / 100).alias("onset"), F.when(F.col("p") % 2 == 0, 0.25).alias("duration"), F.concat(F.lit("note "), F.col("event_id").cast("string")).alias("text"))


def edf_file(spark, sf, **more) -> DataFrame:
    path = os.path.join(scratch.folder(spark, "edf"), "r.edf")
    edf.write(whole_records(spark, sf), path, datetime(2025, 11, 1, 13, 4, 5), 1.0, SIGNALS, **more)
    return edf.scan(spark, path)


@query(DIGITAL + "select record, signal_no::int as signal_no, k::int as k, d as digital, round((d - -32768.0) * (2000.0 / 65535.0) + -1000.0, 6) as physical from w")
def edf_samples(spark, sf):
    file = edf_file(spark, sf).where("notes is null")
    each = file.select("record", "signal_no", "step", "pmin", "dmin", F.posexplode("digital").alias("k", "digital"))
    return each.select("record", "signal_no", "k", "digital", F.round((F.col("digital") - F.col("dmin")) * F.col("step") + F.col("pmin"), 6).alias("physical"))


NOTES = DIGITAL + ", n as (select (p / 100)::double as onset, case when p % 2 = 0 then 0.25::double end as duration, 'note ' || event_id as text from d where event_type = 'purchase'), z as (select max(record) as last from w) "


@query(NOTES + "select least(floor(onset + 0.000000001)::bigint, last) as record, round(onset, 6) as onset, duration, text from n, z")
def edf_annotations(spark, sf):
    file = edf_file(spark, sf, notes=notes_of(spark, sf))
    return edf.annotations(file).select("record", F.round("onset", 6).alias("onset"), "duration", "text")


@query(NOTES + "select least(floor(onset + 0.000000001)::bigint, last) as record, round(onset, 6) as onset, duration, text from n, z")
def sql_tal_parse(spark, sf):
    tables.register(spark)
    edf_file(spark, sf, notes=notes_of(spark, sf)).createOrReplaceTempView("edf_records")
    return spark.sql("select e.record, round(t.onset, 6) as onset, t.duration, t.text from edf_records e, lateral tal_parse(e.notes) t where e.notes is not null and t.text <> ''")


@query(NOTES + ", o as (select distinct record, (record + 5 * (record // 10))::double as onset from w), a as (select n.text, max(o.record) as record from n join o on o.onset <= n.onset + 0.000000001 group by all) select 'record' as what, record, onset from o union all select text as what, coalesce(record, 0) as record, round(n.onset, 6) as onset from n left join a using (text)")
def edf_pauses(spark, sf):
    records = whole_records(spark, sf)
    onsets = records.select("record").distinct().withColumn("onset", (F.col("record") + 5 * F.expr("record div 10")).cast("double"))
    path = os.path.join(scratch.folder(spark, "edf"), "d.edf")
    edf.write(records, path, datetime(2025, 11, 1, 13, 4, 5), 1.0, SIGNALS, notes_of(spark, sf), kind="edf+d", onsets=onsets)
    file = edf.scan(spark, path)
    kept = edf.record_onsets(file).select(F.lit("record").alias("what"), "record", "onset")
    return kept.unionByName(edf.annotations(file).select(F.col("text").alias("what"), "record", F.round("onset", 6).alias("onset")))


@query("select l_orderkey as key, round(l_quantity * 1000, 3) as a, round(l_extendedprice * 1000, 3) as b from lineitem")
def vendor_text(spark, sf):
    l = spark.read.parquet(f"{sf}/lineitem.parquet")
    comma = lambda c: F.translate(F.col(c).cast("string"), ".", ",")
    lines = l.select(F.concat_ws("\t", F.date_format("l_shipdate", "dd.MM.yyyy HH:mm:ss"), comma("l_orderkey"), comma("l_quantity"), comma("l_extendedprice")).alias("value"))
    path = f"file://{scratch.folder(spark, 'text')}/export"
    lines.unionByName(spark.createDataFrame([("% a comment",), ("",)], "value string")).write.text(path)
    v = lambda k: F.get("values", F.lit(k))
    return texts.vendor_text(spark, path).select((v(1) / 1000).cast("long").alias("key"), F.round(v(2), 3).alias("a"), F.round(v(3), 3).alias("b"))


@query("select o_orderkey as key, epoch_us(o_orderdate) as us, o_orderstatus as message from orders")
def sidecar_events(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    one = F.struct(micros("o_orderdate").alias("Timestamp"), F.col("o_orderkey").alias("Author"), F.col("o_orderstatus").alias("Message"))
    path = f"file://{scratch.folder(spark, 'json')}/sidecar"
    o.groupBy("o_orderpriority").agg(F.collect_list(one).alias("Events")).write.partitionBy("o_orderpriority").json(path)
    e = texts.sidecar_events(spark, path)
    return e.select(F.col("event.Author").alias("key"), F.col("event.Timestamp").alias("us"), F.col("event.Message").alias("message"))


@query("select n_nationkey as amp_input, n_name as label from nation")
def labels_file(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet").select(F.concat_ws("\t", F.col("n_nationkey").cast("string"), "n_name").alias("value"))
    path = f"file://{scratch.folder(spark, 'labels')}/labels"
    n.unionByName(spark.createDataFrame([("# a comment",), ("",)], "value string")).write.text(path)
    return texts.labels(spark, path)


@query("with w as (select source, count(*) as windows, round(avg(quality), 9) as mean from labels join documents using (doc_id) where source is not null group by all), f as (select source, count(*) as documents from documents where source is not null and doc_id % 7 = 0 group by all) select coalesce(w.source, f.source) as source, windows, mean, documents from w full join f on w.source = f.source")
def csv_predictions(spark, sf):
    """Two kinds of result files, by window and by file, read from CSV and met by what they are about."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source").where("source is not null")
    path = f"file://{scratch.folder(spark, 'csv')}"
    spark.read.parquet(f"{sf}/labels.parquet").join(d, "doc_id").select("source", F.col("quality").alias("pred")).write.option("header", "true").csv(f"{path}/windows")
    d.where("doc_id % 7 = 0").select("source", "doc_id").write.option("header", "true").csv(f"{path}/files")
    windows, files = (texts.results(spark, f"{path}/{x}") for x in ("windows", "files"))
    w = windows.groupBy("source").agg(F.count("*").alias("windows"), F.round(F.avg(F.col("pred").cast("double")), 9).alias("mean"))
    return w.join(files.groupBy("source").agg(F.count("*").alias("documents")), "source", "full").select("source", "windows", "mean", "documents")


@query(E + "x as (select 1) select event_id, us * 10 + event_id % 10 as ticks from e")
def parse_ticks(spark, sf):
    e = events(spark, sf)
    text = F.concat(F.expr("substring(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\"), 1, 26)"), (F.col("event_id") % 10).cast("string"))
    return e.select("event_id", ticks_of_text(text).alias("ticks"))


@query("select o_orderkey, epoch_us(o_orderdate) + o_orderkey % 1000 - (o_custkey % 5) * 1000000 + 3600000000 as local_us from orders")
def local_starts(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").withColumn("us", micros("o_orderdate"))
    at = local_start(F.timestamp_micros("us"), F.col("o_orderkey") % 1000, F.col("o_custkey") % 5, "UTC+01:00")
    return o.select("o_orderkey", F.unix_micros(at).alias("local_us"))


@query("with t as (select c_custkey, case c_custkey % 3 when 0 then (c_custkey * 1.5)::varchar when 1 then c_name else '-' || c_custkey || 'e2' end as v from customer) select c_custkey, case when regexp_full_match(v, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') then v::double end as number, case when not regexp_full_match(v, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') then v end as text from t")
def number_or_text(spark, sf):
    k = F.col("c_custkey")
    v = F.when(k % 3 == 0, (k * F.lit(1.5).cast("decimal(3,1)")).cast("string")).when(k % 3 == 1, F.col("c_name")).otherwise(F.concat(F.lit("-"), k.cast("string"), F.lit("e2")))
    number, text = sig.number_or_text(v)
    return spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", number.alias("number"), text.alias("text"))


INPUTS = ", ".join(f"({k}, {a}, '{ {i + 3: e for i, e in enumerate(layout.ELECTRODES)}.get(a) or names[a] }', '{refs.get(a, layout.REFERENCE)}')" for k, (_, names, refs, _) in layout.HEADBOXES.items() for a in range(1, 33))


@query(f"with s as (select s_suppkey, case s_suppkey % 3 when 0 then 5 when 1 then 1 else 9 end as amp_type, 1 + s_nationkey * 2 as amp_input from supplier), i(kind, amp, name, reference) as (values {INPUTS}) select s_suppkey, amp_type in (1, 5) as known, case when amp_type = 5 then 'Apollo' else 'Essentia' end as headbox, substring(case when name is null then 'EEG ch' || amp_input || '-Cz' else 'EEG ' || name || '-' || reference end, 1, 16) as label from s left join i on i.kind = case when amp_type in (1, 5) then amp_type else 1 end and i.amp = amp_input")
def headbox_labels(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, 5).when(F.col("s_suppkey") % 3 == 1, 1).otherwise(9).alias("amp_type"), (1 + F.col("s_nationkey") * 2).alias("amp_input"))
    boxes = layout.headboxes(spark)
    met = s.join(F.broadcast(boxes), "amp_type", "left").withColumn("known", F.col("headbox").isNotNull())
    met = met.withColumn("amp_type", F.when(F.col("known"), F.col("amp_type")).otherwise(layout.DEFAULT)).withColumn("headbox", F.coalesce("headbox", F.lit(layout.HEADBOXES[layout.DEFAULT][0])))
    met = met.join(F.broadcast(layout.inputs(spark)), ["amp_type", "amp_input"], "left")
    label = sig.channel_label(F.col("name"), F.col("reference"), F.col("amp_input"), F.lit(None).cast("string"))
    return met.select("s_suppkey", "known", "headbox", label.alias("label"))


@query(FR + "o as (select min(frame_no) + 24 as first, min(frame_no) + 240 as last from f) select user_id, frame_no - first as frame_no, n from f, o where frame_no between first and last")
def frame_range(spark, sf):
    f = frame_table(spark, sf)
    first = f.agg(F.min("frame_no")).first()[0] or 0
    return frames.in_range(f, "frame_no", first + 24, first + 240).select("user_id", "frame_no", "n")


@query(FR + "s as (select user_id, sum(n) - arg_max(n, frame_no) as k, arg_max(start_us, frame_no) - arg_min(start_us, frame_no) as span from f group by all) select user_id, round(k::double / (span::double / 3600000000.0::double), 9) as rate from s where span > 0")
def effective_rates(spark, sf):
    return frames.effective_rate(frame_table(spark, sf), "user_id", "frame_no", "n", "start_us", float(HOUR)).withColumn("rate", F.round("rate", 9))


@query(FR + "d as (select user_id, (start_us - frame_no * 3600000000) - lag(start_us - frame_no * 3600000000) over (partition by user_id order by frame_no) as step from f) select user_id, count(*) as n, round(avg(step), 6) as mean, min(step) as least, max(step) as greatest from d where step is not null group by user_id")
def clock_drift(spark, sf):
    f = frame_table(spark, sf).withColumn("ticks", F.col("frame_no") * HOUR)
    return frames.drift(f, "user_id", "frame_no", "start_us", "ticks").withColumn("mean", F.round("mean", 6))


@query(FR + "d as (select user_id, frame_no, start_us, lag(start_us) over (partition by user_id order by frame_no) as before from f) select user_id, frame_no, start_us from d where start_us < before + 3600000000 - 0.000000001")
def onset_order(spark, sf):
    return frames.out_of_order(frame_table(spark, sf), "user_id", "frame_no", "start_us", float(HOUR)).select("user_id", "frame_no", "start_us")


@query(FR + "g as (select user_id, lag(frame_no) over (partition by user_id order by frame_no) as p, frame_no from f) select user_id, (p + 1)::double as onset, (frame_no - p - 1)::double as duration, 'Recording gap' as text from g where frame_no > p + 1")
def gap_notes(spark, sf):
    found = frames.gap_annotations(frames.gaps(frame_table(spark, sf), "user_id", "frame_no"), "user_id")
    return found.select("user_id", F.col("onset").cast("double").alias("onset"), F.col("duration").cast("double").alias("duration"), "text")


@query(FR + "o as (select min(frame_no) as origin from f), r as (select user_id, frame_no - origin as frame_no, n from f, o), m as (select user_id, min(frame_no) as first from r group by all), z as (select user_id, unnest(generate_series(0, first - 1)) as frame_no, 0::bigint as n from m where first > 0) select user_id, frame_no, n from r union all select * from z")
def leading_pad(spark, sf):
    f = frame_table(spark, sf)
    f = f.crossJoin(F.broadcast(f.agg(F.min("frame_no").alias("origin")))).select("user_id", (F.col("frame_no") - F.col("origin")).alias("frame_no"), "n")
    return frames.led(f, "user_id", "frame_no", {"n": F.lit(0).cast("long")})


@query(FR + "r as (select user_id, frame_no as record from f), g as (select user_id, frame_no + 0.5 as start, frame_no + 3.0 as end_ from f where n > 1) select user_id, record from r where not exists (select 1 from g where g.user_id = r.user_id and r.record >= ceil(g.start) and r.record < floor(g.end_))")
def record_mask(spark, sf):
    f = frame_table(spark, sf)
    holes = f.where("n > 1").select("user_id", (F.col("frame_no") + 0.5).alias("start"), (F.col("frame_no") + 3.0).alias("end"))
    return frames.records_outside(f.select("user_id", F.col("frame_no").alias("record")), holes, "user_id")


@query("with c as (select l_shipmode_ as check_, case when bad > 0 then 'FAIL' else 'PASS' end as status from (select l_linenumber::varchar as l_shipmode_, count(*) filter (l_quantity > 49.5) as bad from lineitem group by all)) select bool_and(status <> 'FAIL') as passed, count(*) filter (status = 'FAIL') as failed from c")
def verdicts(spark, sf):
    l = spark.read.parquet(f"{sf}/lineitem.parquet")
    checks = l.groupBy(F.col("l_linenumber").cast("string").alias("check")).agg(F.count_if(F.col("l_quantity") > 49.5).alias("bad"))
    return compare.verdict(checks.select("check", F.when(F.col("bad") > 0, "FAIL").otherwise("PASS").alias("status")))


@query("select l_partkey, max(l_quantity) as step from lineitem group by l_partkey order by step desc, l_partkey limit 5")
def worst_channels(spark, sf):
    l = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_partkey").agg(F.max("l_quantity").alias("step"))
    return compare.worst(l, "step", "l_partkey", 5)


@query(E + "x as (select 1) select event_id, event_type from e order by us, event_id limit 40")
def first_events(spark, sf):
    return events(spark, sf).orderBy("us", "event_id").limit(40).select("event_id", "event_type")


@query("select o_custkey, count(*) as n, arg_min(o_orderkey, (o_orderdate, o_orderkey)) as first_order, array_to_string(list_sort(list_distinct(list(o_orderstatus))), ',') as statuses from orders group by o_custkey")
def first_rows(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"), F.array_join(F.sort_array(F.collect_set("o_orderstatus")), ",").alias("statuses"))


REQUIRED = ("click", "purchase", "resize", "view")


@query(f"with u as (select distinct user_id, event_type from events), r(kind) as (values {', '.join(f'($${x}$$)' for x in REQUIRED)}), a as (select distinct user_id, kind from u, r), m as (select a.user_id, kind from a left join u on u.user_id = a.user_id and u.event_type = a.kind where u.user_id is null) select distinct u.user_id, coalesce((select string_agg(kind, ',' order by kind) from m where m.user_id = u.user_id), '') as missing from u")
def required_inputs(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"))
    missing = F.array_except(F.array(*map(F.lit, REQUIRED)), F.col("kinds"))
    return e.select("user_id", F.array_join(F.sort_array(missing), ",").alias("missing"))


@query(E + "p as (select *, row_number() over (partition by user_id order by us, event_id) as pos from e), k as (select unnest(generate_series(-2, 5)) as lag), m as (select a.user_id, k.lag, sum(b.value::decimal(18, 6)) as total from p a, k, p b where a.event_type = 'purchase' and a.user_id = b.user_id and b.pos = a.pos + k.lag group by all) select user_id, arg_max(lag, (total, -lag))::int as latency from m group by user_id")
def epoch_peak(spark, sf):
    p = events(spark, sf).withColumn("pos", F.row_number().over(W.partitionBy("user_id").orderBy("us", "event_id")))
    at = p.where("event_type = 'purchase'").select("user_id", F.col("pos").alias("p0"), F.explode(F.sequence(F.lit(-2), F.lit(5))).alias("lag")).withColumn("pos", F.col("p0") + F.col("lag"))
    sums = at.join(p.select("user_id", "pos", "value"), ["user_id", "pos"]).groupBy("user_id", "lag").agg(F.sum(F.col("value").cast("decimal(18,6)")).alias("total"))
    return sums.groupBy("user_id").agg(F.max_by("lag", F.struct(F.col("total"), -F.col("lag"))).alias("latency"))


@query("select count(*) as n, sum(('0x' || substring(sha256(o_orderkey || '|' || o_custkey || '|' || coalesce(o_orderstatus, chr(0)) || '|' || o_orderpriority), 1, 8))::bigint)::bigint as digest from orders")
def table_digest(spark, sf):
    """The same for two tables with the same rows, in whatever order."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return o.select(sig.row_digest("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").alias("d")).agg(F.count("*").alias("n"), F.sum("d").alias("digest"))


PIECES = ", ".join(f"sum(('0x' || substring(h, {1 + 15 * k}, 15))::bigint::hugeint) as s{k}" for k in range(4))
LEVEL = "select node // 64 as node, sum(n)::bigint as n, sha256(string_agg(node || ':' || digest, '|' order by node)) as digest from"
TREE = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
ROW = ", ".join(f"coalesce(length({c}::varchar) || ':' || {c}::varchar, 'n')" for c in TREE)


@query(f"with r as (select o_orderkey // 256 as node, sha256(concat({ROW})) as h from orders), s as (select node, count(*) as n, {PIECES} from r group by node), a as (select node, n, sha256(concat_ws('|', n, s0, s1, s2, s3)) as digest from s), b as ({LEVEL} a group by all), c as ({LEVEL} b group by all) select 0 as level, * from a union all select 1, * from b union all select 2, * from c")
def tree_digest(spark, sf):
    """All nodes of the table's tree up to level 2."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return digests.write_tree(o, "o_orderkey", TREE, f"file://{scratch.folder(spark, 'tree')}/orders", levels=2)


@query("with s as (select l_returnflag, count(*) as n, sum((l_quantity * l_quantity)::decimal(38, 4)) as xx, sum((l_quantity * l_tax)::decimal(38, 6)) as xy, sum((l_tax * l_tax)::decimal(38, 6)) as yy from lineitem group by all) select l_returnflag, round(sqrt(greatest(0, yy::double - xy::double * xy::double / xx::double) / (n - 1) / xx::double), 9) as se from s")
def gain_error(spark, sf):
    l = spark.read.parquet(f"{sf}/lineitem.parquet")
    return compare.gain_through_origin(l, "l_returnflag", "l_quantity", "l_tax").select("l_returnflag", F.round("se", 9).alias("se"))


@query("select distinct text from (select event_type as text from events union select o_orderpriority as text from orders)")
def texts_union(spark, sf):
    e, o = spark.read.parquet(f"{sf}/events.parquet"), spark.read.parquet(f"{sf}/orders.parquet")
    return e.select(F.col("event_type").alias("text")).union(o.select("o_orderpriority")).distinct()


@query(E + "x as (select user_id, min(us) as first, max(us) as last, count(*) as n from e group by all) select user_id, '{\"frames\":' || n || ',\"first\":' || first || ',\"last\":' || last || '}' as report from x")
def json_report(spark, sf):
    x = events(spark, sf).groupBy("user_id").agg(F.struct(F.count("*").alias("frames"), F.min("us").alias("first"), F.max("us").alias("last")).alias("r"))
    return x.select("user_id", F.to_json("r").alias("report"))


@query("select t || '.parquet' as name, false as sqlite, 'PAR1' as magic from (values ('region'), ('nation'), ('supplier'), ('labels')) as v(t)")
def magic_sniff(spark, sf):
    """A table may be a file or a folder of files; bytes of a kind count once."""
    found = texts.sniffed(spark, *(f"{sf}/{t}.parquet" for t in ("region", "nation", "supplier", "labels")))
    return found.select("name", "sqlite", F.substring("magic", 1, 4).alias("magic")).distinct()

