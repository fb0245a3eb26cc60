"""Queries of vectors and artifacts over ``embeddings`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions import text as tx
from lexloom.functions import vectors as vf
from lexloom.operators import descriptors, evaluate, links, segment, vectors
from lexloom.plans.registry import Registry, table
from lexloom.plans.segmentation import PLAIN
from lexloom.session import cut

R = Registry()
documents = lambda spark, d: table(spark, d, "documents").select("doc_id", "text")


def vecs(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), vf.doubles(F.col("embedding")).alias("v"), "label")


V = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"


@R.query("l2_normalize", f"WITH {V} SELECT id, i - 1 AS pos, round(2 * v[i] / sqrt(list_inner_product(v, v) * 4), 6) AS x FROM e, range(1, len(v) + 1) AS r(i)")
def l2_normalize(spark, sf_dir):
    u = vecs(spark, sf_dir).withColumn("u", vf.l2_normalize(F.transform("v", lambda x: 2 * x)))
    return u.select("id", F.posexplode("u").alias("pos", "x")).select("id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@R.query("scaled_normalize", f"WITH {V} SELECT id, round(list_sum(list_transform(v, lambda x: abs(x))) / sqrt(list_inner_product(v, v)), 6) AS one_norm FROM e")
def scaled_normalize(spark, sf_dir):
    huge = vf.scaled_normalize(F.transform("v", lambda x: x * 1e200))
    return vecs(spark, sf_dir).select("id", F.round(F.aggregate(huge, F.lit(0.0), lambda s, x: s + F.abs(x)), 6).alias("one_norm"))


@R.query("cosine", f"WITH {V} SELECT a.id, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM e a JOIN e b ON b.id = a.id + 1")
def cosine(spark, sf_dir):
    a = vecs(spark, sf_dir).withColumn("u", vf.l2_normalize(F.col("v")))
    b = a.select((F.col("id") - 1).alias("id"), F.col("u").alias("w"))
    return a.join(b, "id").select("id", F.round(vf.cosine(F.col("u"), F.col("w")), 6).alias("cosine"))


@R.query("check_matrix", f"WITH {V} SELECT id, 'norm' AS rule FROM e WHERE id % 10 = 0")
def check_matrix(spark, sf_dir):
    v = vecs(spark, sf_dir)
    return vectors.check_matrix(v.select("id", F.when(F.col("id") % 10 == 0, F.transform("v", lambda x: x * 1.001)).otherwise(F.col("v")).alias("v")), 64)


@R.query("weighted_vector_mean", f"WITH {V} SELECT label, i - 1 AS pos, round(sum(v[i] * (1 + id % 3)) / sum(1 + id % 3), 6) AS x FROM e, range(1, 65) AS r(i) GROUP BY 1, 2")
def weighted_vector_mean(spark, sf_dir):
    m = vectors.weighted_mean(vecs(spark, sf_dir).withColumn("w", 1 + F.col("id") % 3), "label")
    return m.select("label", F.posexplode("v").alias("pos", "x")).select("label", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@R.query("derive_vector", f"WITH {V}, m AS (SELECT label, i, avg(v[i]) AS x FROM e, range(1, 65) AS r(i) GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY 1) SELECT label, i - 1 AS pos, round(x / n, 6) AS x FROM m JOIN n USING (label)")
def derive_vector(spark, sf_dir):
    m = vectors.weighted_mean(vecs(spark, sf_dir).withColumn("w", F.lit(1)), "label").withColumn("v", vf.l2_normalize(F.col("v")))
    return m.select("label", F.posexplode("v").alias("pos", "x")).select("label", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@R.query("artifacts")
def artifacts(spark, sf_dir):
    return vectors.artifacts(vecs(spark, sf_dir)).select("id", "artifact_id", "sha256_bytes", "format", "dim")


@R.query("encode_decode", "SELECT vec_id AS id, k AS format, 0::BIGINT AS wrong FROM embeddings, (VALUES ('float16'), ('float32'), ('float64')) f(k)")
def encode_decode(spark, sf_dir):
    v = vecs(spark, sf_dir)
    rows = None
    for kind in vf.FORMATS:
        back = vf.decode(kind)(vf.encode(kind)("v"))
        # Stored again, what was read back has the same bytes.
        one = v.withColumn("r", back).withColumn("again", vf.decode(kind)(vf.encode(kind)("r"))).select("id", F.lit(kind).alias("format"), F.size(F.filter(F.zip_with("r", "again", lambda a, b: a != b), lambda x: x)).cast("long").alias("wrong"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


@R.query("check_vectors", "SELECT vec_id AS id, 'hash' AS rule FROM embeddings WHERE vec_id % 7 = 0")
def check_vectors(spark, sf_dir):
    stored = cut(vectors.artifacts(vecs(spark, sf_dir)))
    a = stored.withColumn("sha256_bytes", F.when(F.col("id") % 7 == 0, F.lit("0")).otherwise(F.col("sha256_bytes")))
    return vectors.check_vectors(a.withColumn("artifact_id", F.col("id"))).select(F.col("artifact_id").alias("id"), "rule")


@R.query("vector_bytes", "SELECT format, count(*) AS artifacts, sum(64 * w)::BIGINT AS bytes, 1::BIGINT AS dimensions FROM (SELECT CASE vec_id % 3 WHEN 0 THEN 'float16' WHEN 1 THEN 'float32' ELSE 'float64' END AS format, CASE vec_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 4 ELSE 8 END AS w FROM embeddings) GROUP BY 1")
def vector_bytes(spark, sf_dir):
    v = vecs(spark, sf_dir)
    kind = F.when(F.col("id") % 3 == 0, "float16").when(F.col("id") % 3 == 1, "float32").otherwise("float64")
    rows = v.select(F.col("id").alias("artifact_id"), kind.alias("format"), F.size("v").alias("dim"))
    return evaluate.vector_bytes(rows.unionByName(rows.where("artifact_id % 5 = 0")))


@R.query("vector_report", "SELECT count(*) AS representations, count(DISTINCT vec_id) FILTER (vec_id IS NOT NULL) AS artifacts, count(*) FILTER (vec_id IS NULL) AS empty, bool_and(vec_id IS NOT NULL) AS covered FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def vector_report(spark, sf_dir):
    rows = rep_artifact(spark, sf_dir)
    return rows.agg(F.count(F.lit(1)).alias("representations"), F.count_distinct("artifact_id").alias("artifacts"), F.count_if(F.col("artifact_id").isNull()).alias("empty"), F.every(F.col("artifact_id").isNotNull()).alias("covered"))


@R.query("rep_artifact", "SELECT doc_id, vec_id AS artifact_id, label FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def rep_artifact(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("artifact_id"), "label")
    return table(spark, sf_dir, "documents").select("doc_id").join(v, F.col("doc_id") == F.col("artifact_id"), "left")


@R.query("cache_key", "SELECT doc_id, sha256('{\"config\":\"c1\",\"input\":\"' || sha256(text) || '\",\"tokens\":' || length(text) || '}') AS cache_key FROM documents")
def cache_key(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", vectors.cache_key(F.lit("c1"), F.sha2("text", 256), F.length("text")).alias("cache_key"))


@R.query("input_budget", "SELECT count(*) AS inputs, sum(n)::BIGINT AS bytes FROM (SELECT DISTINCT text, strlen(text) AS n FROM documents)")
def input_budget(spark, sf_dir):
    return vectors.input_budget(documents(spark, sf_dir))


@R.query("component_closure", "WITH RECURSIVE p AS (SELECT vec_id AS artifact, vec_id // 2 AS component FROM embeddings WHERE vec_id > 0), c AS (SELECT artifact, component FROM p UNION SELECT c.artifact, p.component FROM c JOIN p ON p.artifact = c.component), own AS (SELECT artifact FROM p UNION SELECT component FROM p) SELECT artifact, component FROM c UNION SELECT artifact, artifact FROM own")
def component_closure(spark, sf_dir):
    return vectors.component_closure(vecs(spark, sf_dir).where("id > 0").select(F.col("id").alias("artifact"), F.floor(F.col("id") / 2).alias("component")), rounds=40)


@R.query("orphan_artifacts", "SELECT doc_id AS artifact_id, 'absent' AS side FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT vec_id, 'unused' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)")
def orphan_artifacts(spark, sf_dir):
    return vectors.orphan_artifacts(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("artifact_id")), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("artifact_id")))


@R.query("content_token_count", "SELECT doc_id, greatest(0, length(text) - 7)::BIGINT AS tokens FROM documents WHERE text IS NOT NULL")
def content_token_count(spark, sf_dir):
    """One token for each code point and two specials; the first seven code points are the prefix."""
    n = F.length("text")
    starts = F.concat(F.array(F.lit(0)), F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), F.array(F.lit(0)))
    ends = F.concat(F.array(F.lit(0)), F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), F.array(F.lit(0)))
    special = F.concat(F.array(F.lit(1)), F.array_repeat(F.lit(0), n), F.array(F.lit(1)))
    return documents(spark, sf_dir).where("text IS NOT NULL").select("doc_id", starts.alias("s"), ends.alias("e"), special.alias("p")).select("doc_id", vectors.content_tokens(F.col("s"), F.col("e"), F.col("p"), 7).alias("tokens"))


@R.query("chunk_plan")
def chunk_plan(spark, sf_dir):
    docs = documents(spark, sf_dir)
    stops = links.candidate_passages(docs).groupBy("doc_id").agg(F.array_sort(F.collect_list("end")).alias("stops"))
    return vectors.chunk_plan(docs.join(stops, "doc_id", "left"), 512)


@R.query("describe_inputs", "SELECT doc_id, 'document' AS kind, sha256(text) AS sha256 FROM documents UNION ALL SELECT doc_id, 'head', sha256(substring(text, 1, 2000)) FROM documents")
def describe_inputs(spark, sf_dir):
    d = documents(spark, sf_dir)
    head = d.select("doc_id", F.lit("head").alias("kind"), F.substring("text", 1, 2000).alias("text"))
    both = d.select("doc_id", F.lit("document").alias("kind"), "text").unionByName(head)
    return both.select("doc_id", "kind", F.sha2("text", 256).alias("sha256"))


@R.query("context_inputs", f"WITH {PLAIN} SELECT DISTINCT sha256(text) AS input_sha256, 16 AS dim FROM sentences")
def context_inputs(spark, sf_dir):
    """Distinct sentences of the texts as they are, embedded once each by the deterministic embedder, as artifacts."""
    s = segment.sentences(documents(spark, sf_dir)).select("text")
    return vectors.artifacts(vectors.embed_distinct(s, vectors.hashing_embedder())).select("input_sha256", "dim")


@R.query("sha256_text", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def sha256_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", tx.sha256_text(F.col("text")).alias("sha256"))


@R.query("canonical_json", "SELECT doc_id, '{\"chars\":' || n_chars || ',\"lang\":\"' || lang || '\",\"none\":null,\"source\":\"' || source || '\"}' AS json FROM documents")
def canonical_json(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.canonical_json(chars=F.col("n_chars"), lang=F.col("lang"), source=F.col("source"), none=F.lit(None).cast("string")).alias("json"))


@R.query("slice", "SELECT doc_id, substring(text, 11, 20) AS part, text[1:1] = upper(text[1:1]) AND regexp_matches(text, '^\\p{L}') AS upper_letter FROM documents")
def slice_(spark, sf_dir):
    first = F.substring("text", 1, 1)
    return documents(spark, sf_dir).select("doc_id", tx.slice_text(F.col("text"), F.lit(10), F.lit(30)).alias("part"), ((first == F.upper(first)) & F.col("text").rlike(r"^\p{L}")).alias("upper_letter"))


@R.query("iso_with_offset", "SELECT o_orderkey, o_orderkey % 3 = 0 AS valid FROM orders")
def iso_with_offset(spark, sf_dir):
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    shown = F.when(F.col("o_orderkey") % 3 == 0, F.concat(stamp, F.lit("-03:00"))).when(F.col("o_orderkey") % 3 == 1, stamp).otherwise(F.concat(F.lit("2024-13-45T00:00:00"), F.lit("Z")))
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.iso_with_offset(shown).alias("valid"))


@R.query("local_time", "SELECT o_orderkey, strftime((o_orderdate::TIMESTAMP AT TIME ZONE 'UTC') AT TIME ZONE 'America/Sao_Paulo', '%d/%m/%Y %H:%M') AS shown FROM orders")
def local_time(spark, sf_dir):
    local = F.from_utc_timestamp("o_orderdate", "America/Sao_Paulo")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(local, "dd/MM/yyyy HH:mm").alias("shown"))


@R.query("unit_id", "SELECT doc_id, 'run' || doc_id || ':token:' || n_chars AS id FROM documents")
def unit_id(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.unit_id(F.concat(F.lit("run"), F.col("doc_id").cast("string")), "token", F.col("n_chars")).alias("id"))


@R.query(
    "rep_lookup",
    """WITH w AS (SELECT DISTINCT doc_id AS representation_id FROM labels UNION SELECT -1 - doc_id FROM labels),
u AS (SELECT doc_id AS representation_id, doc_id AS artifact_id FROM documents UNION SELECT doc_id, unnest([2 * doc_id, 2 * doc_id + 1]) FROM documents),
f AS (SELECT representation_id, bool_or(vec_id IS NULL) AS lacks, coalesce(string_agg(vec_id || ':' || label, ',' ORDER BY vec_id), '') AS artifacts FROM u LEFT JOIN embeddings ON vec_id = artifact_id GROUP BY 1)
SELECT w.representation_id, CASE WHEN f.representation_id IS NULL THEN 'missing' WHEN lacks THEN 'incomplete' END AS fault, coalesce(artifacts, '') AS artifacts FROM w LEFT JOIN f USING (representation_id)""",
)
def rep_lookup(spark, sf_dir):
    """Documents are representations with an artifact of their own number and two fragments' artifacts; labelled ones are looked up, and some that do not exist."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("representation_id"), F.col("doc_id").alias("artifact_id"))
    pieces = d.select("representation_id", F.explode(F.array(2 * F.col("artifact_id"), 2 * F.col("artifact_id") + 1)).alias("artifact_id"))
    wanted = table(spark, sf_dir, "labels").select(F.explode(F.array("doc_id", -1 - F.col("doc_id"))).alias("representation_id"))
    found = vectors.lookup(wanted, d, pieces, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("artifact_id"), "label"))
    shown = F.transform("artifacts", lambda x: F.concat(x["artifact_id"].cast("string"), F.lit(":"), x["label"].cast("string")))
    return found.select("representation_id", "fault", F.coalesce(F.array_join(shown, ","), F.lit("")).alias("artifacts"))


# Of a part's two descriptors the second one lacks the kind, has another brand, a new empty object, or an object for its size, by the part's number.
@R.query(
    "descriptor_paths",
    """SELECT * FROM (
SELECT p_partkey AS id, 'model.name' AS path, true AS in_a, true AS in_b, '"' || p_name || '"' AS a, '"' || p_name || '"' AS b, true AS equal FROM part
UNION ALL SELECT p_partkey, 'model.files.brand', true, true, '"' || p_brand || '"', CASE WHEN p_partkey % 5 = 0 THEN '"other"' ELSE '"' || p_brand || '"' END, p_partkey % 5 <> 0 FROM part
UNION ALL SELECT p_partkey, 'model.files.kind', true, p_partkey % 3 <> 0, '"' || p_type || '"', CASE WHEN p_partkey % 3 <> 0 THEN '"' || p_type || '"' END, CASE WHEN p_partkey % 3 <> 0 THEN true END FROM part
UNION ALL SELECT p_partkey, 'extra', false, true, NULL, '{}', NULL FROM part WHERE p_partkey % 7 = 0
UNION ALL SELECT p_partkey, 'size', true, true, p_size::VARCHAR, CASE WHEN p_partkey % 4 = 0 THEN '{"n":' || p_size || '}' ELSE p_size::VARCHAR END, p_partkey % 4 <> 0 FROM part
UNION ALL SELECT p_partkey, 'size.n', false, true, NULL, p_size::VARCHAR, NULL FROM part WHERE p_partkey % 4 = 0)""",
)
def descriptor_paths(spark, sf_dir):
    k = F.col("p_partkey")
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    member = lambda name, c: F.concat(F.lit(f'"{name}":'), c)
    body = lambda *members: F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))
    size = F.col("p_size").cast("string")
    a = body(member("size", size), member("model", body(member("name", text(F.col("p_name"))), member("files", body(member("kind", text(F.col("p_type"))), member("brand", text(F.col("p_brand"))))))))
    files = body(member("brand", text(F.when(k % 5 == 0, "other").otherwise(F.col("p_brand")))), F.when(k % 3 != 0, member("kind", text(F.col("p_type")))))
    b = body(member("model", body(member("files", files), member("name", text(F.col("p_name"))))), F.when(k % 7 == 0, F.lit('"extra":{}')), member("size", F.when(k % 4 == 0, body(member("n", size))).otherwise(size)))
    return descriptors.compare(table(spark, sf_dir, "part").select(k.alias("id"), a.alias("a"), b.alias("b"))).withColumn("path", F.array_join("path", "."))
