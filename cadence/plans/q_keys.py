"""Driver queries for sources and sinks (S1-S7), keys and sets (U1-U4) and joins (JN1-JN4, P6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadence.operators import keys as K
from cadence.operators.assemble import align, assemble, concat_features, feature_columns
from cadence.operators.ordinal import ordinal_within
from cadence.plans import fixtures as fx
from cadence.plans.common import big, r6
from cadence.plans.oracle_fixtures import with_fixtures
from cadence.schemas import MANIFEST_UNLABELLED
from cadence.session import scratch_path
from cadence.sources.manifest import read_manifest, union_splits, write_manifest
from cadence.sources.media import list_media, media_inventory, qualified
from cadence.sources.sinks import write_predictions
from cadence.functions.text import FILLERS
from cadence.sources.store import FeatureStore, embedding_rows
from cadence.sources.tables import read_table

KEYS = ["split", "filename"]


def _manifests(spark, d):
    """Train and test manifests written as header CSV (ordered by doc id) and read back."""
    f1 = fx.f1_transcripts(spark, d)
    tr_path, te_path = scratch_path(spark, "train_csv"), scratch_path(spark, "test_csv")
    write_manifest(f1.where(F.col("split") == "train").select("doc_id", "filename", "label"), tr_path, "doc_id")
    write_manifest(f1.where(F.col("split") == "test").select("doc_id", "filename"), te_path, "doc_id")
    return tr_path, te_path


def s1_read_manifest(spark, d):
    f1 = fx.f1_transcripts(spark, d)
    path = scratch_path(spark, "manifest_csv")
    ordered = f1.where(F.col("split") == "train").select("doc_id", "filename", "label")
    write_manifest(ordered, path, "doc_id")
    m = read_manifest(spark, path)
    return m.select("filename", r6("label"), big("position"))


def s2_union_splits(spark, d):
    tr_path, te_path = _manifests(spark, d)
    train = read_manifest(spark, tr_path, with_position=False)
    test = read_manifest(spark, te_path, MANIFEST_UNLABELLED, with_position=False)
    return union_splits(train, test).select("filename", "split", r6("label"))


def s3_s4_feature_store(spark, d):
    f1 = fx.f1_transcripts(spark, d)
    store = FeatureStore(spark, scratch_path(spark, "store"))
    store.write(f1.select("split", "filename", "doc_id", F.length("clean_transcript").alias("n_clean")), "text")
    back = store.read("text")
    return back.select("split", "filename", big("doc_id"), big("n_clean"))


def s5_embedding_store(spark, d):
    emb = read_table(spark, d, "embeddings").select(
        F.lit("all").alias("split"), F.concat(F.lit("vec_"), F.col("vec_id").cast("string")).alias("filename"),
        "embedding", "label")
    store = FeatureStore(spark, scratch_path(spark, "emb"))
    store.write(embedding_rows(emb, KEYS, "embedding"), "emb", partition_by=None)
    later = emb.where("label = 9").select("split", F.concat(F.lit("new_"), "filename").alias("filename"))  # keys the store lacks
    out = store.completeness("emb", emb.select(*KEYS).union(later))
    return out.select(big("rows_a"), big("rows_b"), big("only_a"), big("only_b"), "same")


def s6_media_inventory(spark, d):
    f1 = fx.f1_transcripts(spark, d)
    root = scratch_path(spark, "media")
    # media exist for the train split only, so the test keys are flagged missing
    _write_media(f1.where(F.col("split") == "train").select("split", "filename", "raw_transcript"), qualified(spark, root))
    inv = media_inventory(f1.select(*KEYS), list_media(spark, root))
    return inv.select("split", "filename", big("n_files"), big("bytes"), "missing")


def _write_media(clips, root):
    """Stand-in media: every clip's text as the file root/split/filename."""
    def write(rows):
        from pyarrow import fs as pafs

        store, top = pafs.FileSystem.from_uri(root)
        for r in rows:
            store.create_dir(f"{top}/{r['split']}", recursive=True)
            with store.open_output_stream(f"{top}/{r['split']}/{r['filename']}") as out:
                out.write((r["raw_transcript"] + "\n").encode())

    clips.foreachPartition(write)


def feature_run_incremental(spark, d):
    """The feature-building flow in two runs over one store: the train clips first, then all of them (only the test clips are transcribed, the
    views are rebuilt), then once more (everything is reused). Empty transcripts are error rows."""
    from cadence.functions.text import num_words, text_features
    from cadence.plans.feature_run import build_features

    f1 = fx.f1_transcripts(spark, d)
    store = FeatureStore(spark, scratch_path(spark, "feature_run"))

    def transcribe(clips):
        said = f1.select(*KEYS, "raw_transcript", "clean_transcript")
        return clips.join(said, KEYS).withColumn("error", F.when(F.col("clean_transcript") == "", "no words"))

    def text_view(t):
        return t.select(*KEYS, *[c.alias(n) for n, c in text_features("clean_transcript").items() if n.startswith("disfluency_filler")])

    def length_view(t):
        return t.select(*KEYS, num_words("clean_transcript").alias("num_words"), F.length("raw_transcript").alias("n_raw"))

    views = {"text": text_view, "length": length_view}
    manifest = f1.select(*KEYS, "label")
    ran = [build_features(store, m, transcribe, views) for m in (manifest.where("split = 'train'"), manifest, manifest.union(manifest.limit(5)))]
    versions = [len(store.versions(t)) for t in ("transcripts", "text", "length")]
    steps = F.lit(",".join(str(r.transcribed) for r in ran) + ";" + ",".join(map(str, versions)))
    out = ran[-1].table.join(store.read("transcripts").select(*KEYS, "error"), KEYS)
    return out.select(*KEYS, r6("label"), big("disfluency_filler_count"), r6("disfluency_filler_rate"), big("num_words"), big("n_raw"),
                      F.col("error").isNotNull().alias("failed"), steps.alias("steps"))


def s7_prediction_sink(spark, d):
    f7 = fx.f7_preds(fx.f6_reg(spark, d))
    preds = ordinal_within(f7.select(F.concat(F.lit("ord_"), F.col("id").cast("string")).alias("filename"),
                                     F.col("p4").alias("label"), "id"), [], ["id"], out="position")
    path = scratch_path(spark, "preds_csv")
    write_predictions(preds, path)
    back = spark.read.schema("filename string, label double").option("header", True).csv(path)
    return back.select("filename", r6("label"))


def u1_dedupe_first(spark, d):
    li = read_table(spark, d, "lineitem")
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
             "l_returnflag", "l_linestatus"]
    out = K.dedupe_first(li, ["l_orderkey", "l_linenumber"], order)
    return out.select(big("l_orderkey"), big("l_linenumber"), big("l_partkey"), big("l_suppkey"),
                      r6("l_quantity"), r6("l_extendedprice"), r6("l_discount"), r6("l_tax"),
                      "l_returnflag", "l_linestatus", F.col("l_shipdate").cast("string").alias("l_shipdate"))


def u2_expected_keys(spark, d):
    f1 = fx.f1_transcripts(spark, d)
    return K.expected_keys(f1.where(F.col("split") == "train"), f1.where(F.col("split") == "test"))


def u3_covers(spark, d):
    f1 = fx.f1_transcripts(spark, d)
    return K.covers(f1.where(F.col("split") == "train"), f1, KEYS).select(big("n_expected"), big("n_missing"), "covered")


def u4_same_keys(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id")
    labels = read_table(spark, d, "labels").select("doc_id")
    return K.same_keys(docs, labels, ["doc_id"]).select(big("rows_a"), big("rows_b"), big("only_a"), big("only_b"), "same")


def jn1_assemble(spark, d):
    f1 = fx.f1_transcripts(spark, d)
    docs = read_table(spark, d, "documents")
    labels = read_table(spark, d, "labels")
    view_a = docs.select(F.lit("x").alias("_"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("filename"),
                         "n_chars", "lang").drop("_")
    view_a = f1.select(*KEYS, "doc_id").join(docs.select("doc_id", "n_chars", "lang"), "doc_id").drop("doc_id")
    view_b = labels.select(F.lit("train").alias("split"),
                           F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("filename"),
                           "quality", "toxic")
    out = assemble(f1.select(*KEYS, "label"), [view_a, view_b], KEYS)
    return out.select(*KEYS, r6("label"), big("n_chars"), "lang", big("quality"), big("toxic"))


def jn2_pending(spark, d):
    f1 = fx.f1_transcripts(spark, d)
    return K.pending(f1.select(*KEYS, "doc_id"), f1.where(F.col("split") == "train"), KEYS).select(*KEYS, big("doc_id"))


def jn3_align(spark, d):
    f7 = fx.f7_preds(fx.f6_reg(spark, d))
    long = f7.unpivot(["id"], ["p1", "p2", "p3", "p4"], "model", "pred")
    out = align(long, f7.select("id", "y"), "id", ["p1", "p2", "p3", "p4"])
    return out.select(big("id"), r6("y"), r6("p1"), r6("p2"), r6("p3"), r6("p4"))


def jn4_concat_features(spark, d):
    emb = read_table(spark, d, "embeddings")
    df = emb.select("vec_id", "embedding", F.col("label").cast("double").alias("lab"),
                    (F.col("vec_id") % 7).cast("double").alias("m7"))
    out = concat_features(df, ["lab", "m7"], "embedding")
    return out.select(big("vec_id"), big(F.size("features"), "n_features"),
                      r6(F.aggregate("features", F.lit(0.0), lambda a, x: a + x), "sum_features"),
                      r6(F.element_at("features", 3), "first_embedding"))


def p6_feature_columns(spark, d):
    f6 = fx.f6_reg(spark, d)
    cols = feature_columns(f6, exclude=("id", "y"))
    return f6.select(big("id"), *[r6(c) for c in cols])


QUERIES = {
    "s1_read_manifest": s1_read_manifest,
    "s2_union_splits": s2_union_splits,
    "s3_s4_feature_store": s3_s4_feature_store,
    "s5_embedding_store": s5_embedding_store,
    "s6_media_inventory": s6_media_inventory,
    "feature_run_incremental": feature_run_incremental,
    "s7_prediction_sink": s7_prediction_sink,
    "u1_dedupe_first": u1_dedupe_first,
    "u2_expected_keys": u2_expected_keys,
    "u3_covers": u3_covers,
    "u4_same_keys": u4_same_keys,
    "jn1_assemble": jn1_assemble,
    "jn2_pending": jn2_pending,
    "jn3_align": jn3_align,
    "jn4_concat_features": jn4_concat_features,
    "p6_feature_columns": p6_feature_columns,
}

_F1 = "f1_transcripts"
ORACLES = {
    "s1_read_manifest": with_fixtures("""SELECT filename, round(label, 6) AS label,
        CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS position FROM f1_transcripts WHERE split = 'train'""", _F1),
    "s2_union_splits": with_fixtures("SELECT filename, split, round(label, 6) AS label FROM f1_transcripts", _F1),
    "s3_s4_feature_store": with_fixtures("""SELECT split, filename, CAST(doc_id AS BIGINT) AS doc_id,
        CAST(length(clean_transcript) AS BIGINT) AS n_clean FROM f1_transcripts""", _F1),
    "s5_embedding_store": """SELECT CAST(count(*) AS BIGINT) AS rows_a, CAST(count(*) + count(*) FILTER (WHERE label >= 9) AS BIGINT) AS rows_b,
        CAST(0 AS BIGINT) AS only_a, CAST(count(*) FILTER (WHERE label >= 9) AS BIGINT) AS only_b,
        count(*) FILTER (WHERE label >= 9) = 0 AS same FROM embeddings""",
    "feature_run_incremental": with_fixtures("""WITH w AS (SELECT *, list_filter(string_split(clean_transcript, ' '), lambda x: x <> '') AS ws FROM f1_transcripts),
        x AS (SELECT *, greatest(len(ws), 1) AS nw, len(list_filter(ws, lambda t: t IN (""" + ", ".join(f"'{f}'" for f in FILLERS if " " not in f) + """))) AS fill FROM w)
        SELECT split, filename, round(label, 6) AS label, CAST(fill AS BIGINT) AS disfluency_filler_count, round(fill / nw * 100.0, 6) AS disfluency_filler_rate,
               CAST(nw AS BIGINT) AS num_words, CAST(length(raw_transcript) AS BIGINT) AS n_raw, clean_transcript = '' AS failed,
               (SELECT CAST(count(*) FILTER (WHERE split = 'train') AS VARCHAR) || ',' || CAST(count(*) FILTER (WHERE split = 'test') AS VARCHAR) || ',0;2,2,2' FROM f1_transcripts) AS steps
        FROM x""", _F1),
    "s7_prediction_sink": with_fixtures("SELECT 'ord_' || CAST(id AS VARCHAR) AS filename, round(least(greatest(p4, 0.0), 5.0), 6) AS label FROM f7_preds", "f7_preds"),
    "u1_dedupe_first": """SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
        CAST(l_partkey AS BIGINT) AS l_partkey, CAST(l_suppkey AS BIGINT) AS l_suppkey, round(l_quantity, 6) AS l_quantity,
        round(l_extendedprice, 6) AS l_extendedprice, round(l_discount, 6) AS l_discount, round(l_tax, 6) AS l_tax,
        l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate
      FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey,
              l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS rn FROM lineitem) t WHERE rn = 1""",
    "u2_expected_keys": with_fixtures("SELECT DISTINCT split, filename FROM f1_transcripts", _F1),
    "u3_covers": with_fixtures("""SELECT CAST(count(*) AS BIGINT) AS n_expected, CAST(count(*) FILTER (WHERE split = 'test') AS BIGINT) AS n_missing,
        count(*) FILTER (WHERE split = 'test') = 0 AS covered FROM f1_transcripts""", _F1),
    "u4_same_keys": """SELECT CAST((SELECT count(*) FROM documents) AS BIGINT) AS rows_a, CAST((SELECT count(*) FROM labels) AS BIGINT) AS rows_b,
        CAST((SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS BIGINT) AS only_a,
        CAST((SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS BIGINT) AS only_b,
        (SELECT count(*) FROM documents) = (SELECT count(*) FROM labels)
          AND (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) = 0 AS same""",
    "jn1_assemble": with_fixtures("""SELECT f.split, f.filename, round(f.label, 6) AS label, CAST(d.n_chars AS BIGINT) AS n_chars, d.lang,
        CAST(CASE WHEN f.split = 'train' THEN l.quality END AS BIGINT) AS quality, CAST(CASE WHEN f.split = 'train' THEN l.toxic END AS BIGINT) AS toxic
      FROM f1_transcripts f JOIN documents d ON f.doc_id = d.doc_id LEFT JOIN labels l ON f.doc_id = l.doc_id""", _F1),
    "jn2_pending": with_fixtures("SELECT split, filename, CAST(doc_id AS BIGINT) AS doc_id FROM f1_transcripts WHERE split = 'test'", _F1),
    "jn3_align": with_fixtures("""SELECT CAST(id AS BIGINT) AS id, round(y, 6) AS y, round(p1, 6) AS p1, round(p2, 6) AS p2,
        round(p3, 6) AS p3, round(p4, 6) AS p4 FROM f7_preds""", "f7_preds"),
    "jn4_concat_features": """SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(len(embedding) + 2 AS BIGINT) AS n_features,
        round(CAST(label AS DOUBLE) + CAST(vec_id % 7 AS DOUBLE) + list_sum([CAST(x AS DOUBLE) for x in embedding]), 6) AS sum_features,
        round(CAST(embedding[1] AS DOUBLE), 6) AS first_embedding FROM embeddings""",
    "s6_media_inventory": with_fixtures("""SELECT split, filename,
        CAST(CASE WHEN split = 'train' THEN 1 ELSE 0 END AS BIGINT) AS n_files,
        CAST(CASE WHEN split = 'train' THEN strlen(raw_transcript) + 1 ELSE 0 END AS BIGINT) AS bytes,
        split <> 'train' AS missing FROM f1_transcripts""", _F1),
    "p6_feature_columns": with_fixtures("""SELECT CAST(id AS BIGINT) AS id, round(x1, 6) AS x1, round(x2, 6) AS x2, round(x3, 6) AS x3,
        round(x4, 6) AS x4, round(x_const, 6) AS x_const FROM f6_reg""", "f6_reg"),
}
