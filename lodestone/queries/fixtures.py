"""The driver's tables as modules of a knowledge store, in Spark and, as PRELUDE, in SQL.

canonical: documents (text/plain) and pages (text/html with a tag-stripped view); semantic: part facts, regions,
nations (part_of), suppliers (located_in), quality facts of labels that cite a document; episodic: events; procedural:
conversations; provenance: a derivation of each quality fact, supersessions among parts of one name and brand,
demotions by toxic labels.  Doubles never enter a payload.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.identity import block_id, digest, envelope, jcs, record, utc_timestamp
from lodestone.functions.text import folded

AT = "2026-01-01T00:00:00Z"
ACTOR = {"id": "survey", "kind": "pipeline"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _blocks(df: DataFrame, memory_type: str, payload: Column, version: int = 1) -> DataFrame:
    own = df.withColumn("__p", payload).withColumn("canonical", envelope(memory_type, F.col("__p"), version))
    own = own.withColumns({"block_id": block_id(F.col("canonical")), "payload": jcs(F.col("__p")), "memory_type": F.lit(memory_type)})
    return own.drop("__p")


def documents(spark, sf) -> DataFrame:
    """A row for each document; the same text is the same block."""
    df = read(spark, sf, "documents").where("text IS NOT NULL")
    size = F.octet_length("text").cast("long")
    return _blocks(df, "canonical", record(blob=digest(F.col("text")), media_type=F.lit("text/plain"), size=size))


def plain(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]*>", " ")


def pages(spark, sf) -> DataFrame:
    df = read(spark, sf, "pages").where("html IS NOT NULL").withColumn("view", plain(F.col("html")))
    content = lambda text, kind: {
        "blob": digest(F.col(text)), "media_type": F.lit(kind), "size": F.octet_length(text).cast("long"),
    }
    return _blocks(df, "canonical", record(**content("html", "text/html"), normalized_view=record(**content("view", "text/plain"))))


def parts(spark, sf) -> DataFrame:
    df = read(spark, sf, "part").select(
        "p_partkey", F.lit("fact").alias("kind"), F.col("p_name").alias("label"),
        F.concat_ws(" ", "p_type", F.lit("size"), "p_size").alias("statement"), F.col("p_brand").alias("subject"),
    )
    return _blocks(df, "semantic", _claim())


def _claim(**more: Column) -> Column:
    return record(kind=F.col("kind"), label=F.col("label"), statement=F.col("statement"), subject=F.col("subject"), **more)


def _relation(df: DataFrame) -> DataFrame:
    """df: kind, label, statement, subject, predicate, target."""
    relations = F.array(record(predicate=F.col("predicate"), target=F.col("target")))
    return _blocks(df, "semantic", _claim(relations=relations))


def regions(spark, sf) -> DataFrame:
    df = read(spark, sf, "region").select(
        "r_regionkey", F.lit("concept").alias("kind"), F.col("r_name").alias("label"),
        F.concat(F.lit("region "), "r_name").alias("statement"), F.lit("geography").alias("subject"),
    )
    return _blocks(df, "semantic", _claim())


def nations(spark, sf) -> DataFrame:
    region = F.broadcast(regions(spark, sf).select("r_regionkey", F.col("label").alias("up"), F.col("block_id").alias("target")))  # five rows
    df = read(spark, sf, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return _relation(df.select(
        "n_nationkey", F.lit("relation").alias("kind"), F.col("n_name").alias("label"),
        F.concat("n_name", F.lit(" is part of "), "up").alias("statement"), F.lit("geography").alias("subject"),
        F.lit("part_of").alias("predicate"), "target",
    ))


def suppliers(spark, sf) -> DataFrame:
    nation = nations(spark, sf).select("n_nationkey", F.col("label").alias("up"), F.col("block_id").alias("target"))
    df = read(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return _relation(df.select(
        "s_suppkey", F.lit("relation").alias("kind"), F.col("s_name").alias("label"),
        F.concat("s_name", F.lit(" is located in "), "up").alias("statement"), F.lit("trade").alias("subject"),
        F.lit("located_in").alias("predicate"), "target",
    ))


def quality_facts(spark, sf) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", "source", F.col("block_id").alias("cited"))
    df = read(spark, sf, "labels").join(docs, "doc_id").select(
        "doc_id", "source", "cited", "toxic", F.lit("fact").alias("kind"),
        F.concat(F.lit("quality of document "), F.col("doc_id").cast("string")).alias("label"),
        F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("statement"), F.lit("quality").alias("subject"),
        F.array("cited").alias("evidence"),
    )
    return _blocks(df, "semantic", _claim(evidence=F.col("evidence")))


def events(spark, sf) -> DataFrame:
    df = read(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("summary"), utc_timestamp(F.col("ts")).alias("occurred_at"),
        F.array(F.col("user_id").cast("string")).alias("participants"), F.array("event_type").alias("tags"),
    )
    fields = ("summary", "occurred_at", "participants", "tags")
    return _blocks(df, "episodic", record(**{k: F.col(k) for k in fields}))


def conversations(spark, sf) -> DataFrame:
    """A block for each conversation; a procedure is one object, so its turns are gathered."""
    df = read(spark, sf, "conversations").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    ).select(
        "conv_id", F.concat(F.lit("conversation "), F.col("conv_id").cast("string")).alias("label"),
        F.concat(F.lit("answer in "), F.size("turns").cast("string"), F.lit(" turns")).alias("goal"),
        F.transform("turns", lambda t: record(action=t["text"], condition=t["role"])).alias("steps"),
    )
    return _blocks(df, "procedural", record(goal=F.col("goal"), label=F.col("label"), steps=F.col("steps")))


def _record(df: DataFrame, record_type: str, **fields: Column) -> DataFrame:
    actor = record(**{k: F.lit(v) for k, v in ACTOR.items()})
    own = record(record_type=F.lit(record_type), actor=actor, at=F.lit(AT), **fields)
    return _blocks(df, "provenance", record(record=own))


def _empty() -> dict[str, Column]:
    text = F.lit(None).cast("string")
    return {
        "block": text, "derived_from": F.lit(None).cast("array<string>"), "supersedes": text, "locator": text,
        "producer": F.lit(None).cast("struct<id:string,kind:string,version:string>"), "blocks": F.lit(None).cast("array<string>"),
    }


def provenance(spark, sf) -> DataFrame:
    """(entry_id, record_type, block, blocks, derived_from, supersedes, producer, locator, canonical)."""
    facts = quality_facts(spark, sf).select(
        F.col("block_id").alias("block"), F.col("evidence").alias("derived_from"), "source", "doc_id", "toxic"
    )
    producer = record(id=F.col("source"), kind=F.lit("pipeline"), version=F.lit("1"))
    locator = F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))
    own = facts.withColumns({"producer": producer, "locator": locator})
    derived = _record(own, "derivation", block=F.col("block"), derived_from=F.col("derived_from"), producer=F.col("producer"), locator=F.col("locator"))
    one = Window.partitionBy("label", "subject").orderBy("p_partkey")
    claims = parts(spark, sf).select("p_partkey", "label", "subject", "block_id", F.lag("block_id").over(one).alias("supersedes"))
    newer = claims.where("supersedes IS NOT NULL AND supersedes <> block_id").select(F.col("block_id").alias("block"), "supersedes").distinct()
    newer = _record(newer, "supersession", block=F.col("block"), supersedes=F.col("supersedes"))
    bad = _record(facts.where("toxic = 1").select("block").distinct(), "demotion", block=F.col("block"), reason=F.lit("toxic"))
    columns = ["block", "blocks", "derived_from", "supersedes", "producer", "locator"]
    out = None
    for kind, df in (("derivation", derived), ("supersession", newer), ("demotion", bad)):
        full = df.withColumns({k: v for k, v in _empty().items() if k not in df.columns})
        rows = full.select(F.col("block_id").alias("entry_id"), F.lit(kind).alias("record_type"), *columns, "canonical")
        out = rows if out is None else out.unionByName(rows)
    return out.dropDuplicates(["entry_id"])


def views(spark, sf) -> DataFrame:
    """Block views of all modules but provenance, for retrieval."""
    none, no_text = F.lit(None).cast("array<string>"), F.lit(None).cast("string")

    def view(df: DataFrame, text: Column, subject=no_text, tags=none, evidence=none, occurred_at=no_text) -> DataFrame:
        return df.select(
            "block_id", "memory_type", subject.alias("subject"), tags.alias("tags"), evidence.alias("evidence"),
            occurred_at.alias("occurred_at"), folded(text).alias("haystack"), "payload",
        )

    claim = F.concat_ws(" ", "label", "statement", "subject")
    found = view(documents(spark, sf), F.lit("text/plain"))
    every = [
        view(pages(spark, sf), F.lit("text/html")),
        *(view(f(spark, sf), claim, F.col("subject")) for f in (parts, regions, nations, suppliers)),
        view(quality_facts(spark, sf), claim, F.col("subject"), evidence=F.col("evidence")),
        view(
            events(spark, sf), F.concat_ws(" ", "summary", "participants", "tags"), tags=F.col("tags"), occurred_at=F.col("occurred_at")
        ),
        view(
            conversations(spark, sf),
            F.concat_ws(" ", "label", "goal", F.transform("steps", lambda s: s["action"]), F.transform("steps", lambda s: s["condition"])),
        ),
    ]
    for df in every:
        found = found.unionByName(df)
    return found.dropDuplicates(["block_id"])


def relations(spark, sf) -> DataFrame:
    """(src, dst, predicate) of nations and suppliers."""
    rows = [f(spark, sf).select(F.col("block_id").alias("src"), F.col("target").alias("dst"), "predicate") for f in (nations, suppliers)]
    return rows[0].unionByName(rows[1]).distinct()


def composition(spark, sf) -> DataFrame:
    ids = views(spark, sf).select("memory_type", "block_id")
    return ids.unionByName(provenance(spark, sf).select(F.lit("provenance").alias("memory_type"), F.col("entry_id").alias("block_id")))


def _sql_block(memory_type: str, payload: str, version: int = 1) -> str:
    return (
        f"""'{{"lodestone":1,"memory_type":"{memory_type}","payload":' || ({payload}) || """
        f"""',"schema_version":{version},"serialization":"jcs/1"}}'"""
    )


def _sql_fields(**fields: str) -> str:
    """JSON of SQL expressions that are JSON themselves, keys in order."""
    inside = " || ',' || ".join(f"""'"{k}":' || {fields[k]}""" for k in sorted(fields))
    return f"'{{' || {inside} || '}}'"


def _q(expression: str) -> str:
    return f"CAST(to_json({expression}) AS VARCHAR)"


_CLAIM = {k: _q(k) for k in ("kind", "label", "statement", "subject")}
_RELATION = "'[' || " + _sql_fields(predicate=_q("predicate"), target=_q("target")) + " || ']'"
_ACTOR = _sql_fields(id="'\"survey\"'", kind="'\"pipeline\"'")


def _sql_table(name: str, memory_type: str, payload: str, source: str) -> str:
    return (
        f"{name}_p AS (SELECT *, {payload} AS payload FROM ({source})),\n"
        f"{name}_c AS (SELECT *, {_sql_block(memory_type, 'payload')} AS canonical FROM {name}_p),\n"
        f"{name} AS (SELECT *, 'sha256:' || sha256(canonical) AS block_id, '{memory_type}' AS memory_type FROM {name}_c)"
    )


def _sql_record(name: str, record_type: str, source: str, **fields: str) -> str:
    own = _sql_fields(record_type=f"'\"{record_type}\"'", actor=_ACTOR, at=f"'\"{AT}\"'", **fields)
    return _sql_table(name, "provenance", _sql_fields(record=own), source)


_BLOB = lambda text: f"""'"sha256:' || sha256({text}) || '"'"""
_SIZE = lambda text: f"CAST(octet_length(encode({text})) AS VARCHAR)"

PRELUDE = "WITH " + ",\n".join([
    _sql_table(
        "docs", "canonical", _sql_fields(blob=_BLOB("text"), media_type="'\"text/plain\"'", size=_SIZE("text")),
        "SELECT * FROM documents WHERE text IS NOT NULL",
    ),
    _sql_table(
        "pgs", "canonical",
        _sql_fields(
            blob=_BLOB("html"), media_type="'\"text/html\"'", size=_SIZE("html"),
            normalized_view=_sql_fields(blob=_BLOB("view"), media_type="'\"text/plain\"'", size=_SIZE("view")),
        ),
        "SELECT *, regexp_replace(html, '<[^>]*>', ' ', 'g') AS view FROM pages WHERE html IS NOT NULL",
    ),
    _sql_table(
        "prt", "semantic", _sql_fields(**_CLAIM),
        "SELECT p_partkey, 'fact' AS kind, p_name AS label, p_type || ' size ' || p_size AS statement, p_brand AS subject FROM part",
    ),
    _sql_table(
        "rgn", "semantic", _sql_fields(**_CLAIM),
        "SELECT r_regionkey, 'concept' AS kind, r_name AS label, 'region ' || r_name AS statement, 'geography' AS subject FROM region",
    ),
    _sql_table(
        "ntn", "semantic", _sql_fields(**_CLAIM, relations=_RELATION),
        "SELECT n_nationkey, 'relation' AS kind, n_name AS label, n_name || ' is part of ' || r.label AS statement, 'geography' AS subject,"
        " 'part_of' AS predicate, r.block_id AS target FROM nation JOIN rgn r ON n_regionkey = r_regionkey",
    ),
    _sql_table(
        "spl", "semantic", _sql_fields(**_CLAIM, relations=_RELATION),
        "SELECT s_suppkey, 'relation' AS kind, s_name AS label, s_name || ' is located in ' || n.label AS statement, 'trade' AS subject,"
        " 'located_in' AS predicate, n.block_id AS target FROM supplier JOIN ntn n ON s_nationkey = n_nationkey",
    ),
    _sql_table(
        "qf", "semantic", _sql_fields(**_CLAIM, evidence="'[' || " + _q("cited") + " || ']'"),
        "SELECT doc_id, source, d.block_id AS cited, toxic, 'fact' AS kind, 'quality of document ' || doc_id AS label,"
        " 'quality ' || quality AS statement, 'quality' AS subject FROM labels JOIN docs d USING (doc_id)",
    ),
    _sql_table(
        "evt", "episodic",
        _sql_fields(summary=_q("summary"), occurred_at=_q("occurred_at"), participants="'[' || " + _q("participant") + " || ']'", tags="'[' || " + _q("summary") + " || ']'"),
        "SELECT event_id, event_type AS summary, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS occurred_at, CAST(user_id AS VARCHAR) AS participant FROM events",
    ),
    _sql_table(
        "cnv", "procedural", _sql_fields(goal=_q("goal"), label=_q("label"), steps="steps"),
        "SELECT conv_id, 'conversation ' || conv_id AS label, 'answer in ' || count(*) || ' turns' AS goal,"
        " '[' || string_agg(" + _sql_fields(action=_q("text"), condition=_q("role")) + ", ',' ORDER BY turn, role, text) || ']' AS steps,"
        " string_agg(text, ' ' ORDER BY turn, role, text) || ' ' || string_agg(role, ' ' ORDER BY turn, role, text) AS said FROM conversations GROUP BY conv_id",
    ),
    _sql_record(
        "der", "derivation",
        "SELECT block_id AS block, cited, source, 'doc:' || doc_id AS locator FROM qf",
        block=_q("block"), derived_from="'[' || " + _q("cited") + " || ']'", locator=_q("locator"),
        producer=_sql_fields(id=_q("source"), kind="'\"pipeline\"'", version="'\"1\"'"),
    ),
    _sql_record(
        "sup", "supersession",
        "SELECT DISTINCT block, supersedes FROM (SELECT block_id AS block, lag(block_id) OVER (PARTITION BY label, subject ORDER BY p_partkey) AS supersedes FROM prt)"
        " WHERE supersedes IS NOT NULL AND supersedes <> block",
        block=_q("block"), supersedes=_q("supersedes"),
    ),
    _sql_record("dem", "demotion", "SELECT DISTINCT block_id AS block FROM qf WHERE toxic = 1", block=_q("block"), reason="'\"toxic\"'"),
    """prov AS (
  SELECT DISTINCT block_id AS entry_id, 'derivation' AS record_type, block, cited, NULL AS supersedes, source, locator FROM der
  UNION ALL SELECT block_id, 'supersession', block, NULL, supersedes, NULL, NULL FROM sup
  UNION ALL SELECT block_id, 'demotion', block, NULL, NULL, NULL, NULL FROM dem)""",
    """vw AS (
  SELECT DISTINCT block_id, memory_type, NULL AS subject, NULL AS tag, NULL AS evidence, NULL AS occurred_at, 'text/plain' AS hay, payload FROM docs
  UNION ALL SELECT DISTINCT block_id, memory_type, NULL, NULL, NULL, NULL, 'text/html', payload FROM pgs
  UNION ALL SELECT DISTINCT block_id, memory_type, subject, NULL, NULL, NULL, concat_ws(' ', label, statement, subject), payload FROM prt
  UNION ALL SELECT DISTINCT block_id, memory_type, subject, NULL, NULL, NULL, concat_ws(' ', label, statement, subject), payload FROM rgn
  UNION ALL SELECT DISTINCT block_id, memory_type, subject, NULL, NULL, NULL, concat_ws(' ', label, statement, subject), payload FROM ntn
  UNION ALL SELECT DISTINCT block_id, memory_type, subject, NULL, NULL, NULL, concat_ws(' ', label, statement, subject), payload FROM spl
  UNION ALL SELECT DISTINCT block_id, memory_type, subject, NULL, cited, NULL, concat_ws(' ', label, statement, subject), payload FROM qf
  UNION ALL SELECT DISTINCT block_id, memory_type, NULL, summary, NULL, occurred_at, concat_ws(' ', summary, participant, summary), payload FROM evt
  UNION ALL SELECT DISTINCT block_id, memory_type, NULL, NULL, NULL, NULL, concat_ws(' ', label, goal, said), payload FROM cnv),
views AS (SELECT *, replace(lower(hay), 'ß', 'ss') AS haystack FROM vw),
rel AS (SELECT DISTINCT block_id AS src, target AS dst, predicate FROM ntn UNION SELECT block_id, target, predicate FROM spl),
comp AS (SELECT memory_type, block_id FROM views UNION ALL SELECT 'provenance', entry_id FROM prov)""",
])
