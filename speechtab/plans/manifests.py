"""Queries over manifests, cuts and segments, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechtab.functions import text as X
from speechtab.operators import cuts as C
from speechtab.operators import segments as S
from speechtab.operators.scan import collapse_rows
from speechtab.plans import fixtures as V
from speechtab.plans.fixtures import sql
from speechtab.session import shared_path
from speechtab.sources import manifests as M

Q: dict = {}


def query(body: str | None = None, views: str = ""):
    """Registers the function under its name with its SQL (after the named views)."""

    def keep(f):
        Q[f.__name__] = (f, sql(views, body) if body else None)
        return f

    return keep


LONG = lambda *names: [F.col(n).cast("long").alias(n) for n in names]


def cuts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec, sup = C.fix_manifests(V.recordings(spark, sf_dir), V.supervisions(spark, sf_dir))
    return C.build_cuts(rec.select("recording_id", "source_path", "num_frames", "num_samples", "sampling_rate", "duration", "lang", "n_tokens"), sup)


@query("SELECT lang, count(*) AS n, round(sum(duration) / 3600, 6) AS hours FROM recordings WHERE duration BETWEEN 1 AND 20 AND floor((floor((num_frames - 7) / 2) + 1) / 2) >= n_tokens GROUP BY lang", "recordings")
def cut_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = C.filter_alignable(C.filter_duration(V.recordings(spark, sf_dir), *C.BANDS["prep"]), "train")
    return kept.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.sum("duration") / 3600, 6).alias("hours"))


@query(r"SELECT CAST(doc_id AS VARCHAR) AS utt_id, regexp_replace(text, '[ \t\r\n]+', ' ', 'g') AS text FROM documents WHERE regexp_matches(text, '\S')")
def read_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.table(spark, sf_dir, "documents")
    value = F.concat_ws(" ", F.col("doc_id").cast("string"), F.regexp_replace("text", r"[ \t\r\n]+", " "))
    return M.split_lines(d.select(value.alias("value")))[0].select("utt_id", "text")


@query("SELECT recording_id, lpad(CAST((row_number() OVER (ORDER BY recording_id) - 1) // 300 AS VARCHAR), 8, '0') AS shard FROM recordings", "recordings")
def split_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.split_manifest(V.recordings(spark, sf_dir).select("recording_id"), 300, ["recording_id"]).select("recording_id", "shard")


@query("SELECT recording_id || '-0' AS cut_id, min_by(text, start) AS value FROM supervisions GROUP BY recording_id", "supervisions")
def cuts_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cuts_of(spark, sf_dir)
    return c.select("cut_id", F.get("supervisions", F.lit(0))["text"].alias("value"))


@query("SELECT doc_id, regexp_replace(text, '^[^ ]* ', '') AS value FROM documents")
def transcript_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.transcript_corpus(V.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("value")))


@query("SELECT event_type || ' ' || (dense_rank() OVER (ORDER BY event_type) + 2) AS value FROM (SELECT DISTINCT event_type FROM events) UNION ALL SELECT * FROM (VALUES ('<blk> 0'), ('<sos/eos> 1'), ('<unk> 2'))")
def symbol_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from speechtab.operators.vocab import sorted_vocab

    s = sorted_vocab(V.table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol")), ("<blk>", "<sos/eos>", "<unk>"), ())
    return s.select(F.concat_ws(" ", "symbol", F.col("id").cast("string")).alias("value"))


@query("SELECT recording_id, duration FROM recordings WHERE duration >= 1 AND duration <= 16", "recordings")
def filter_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.filter_duration(V.recordings(spark, sf_dir), *C.BANDS["train"]).select("recording_id", "duration")


@query("SELECT recording_id, floor((floor((num_frames - 1) / 2) - 1) / 2) >= n_tokens AS prep, floor((floor((num_frames - 7) / 2) + 1) / 2) >= n_tokens AS train FROM recordings", "recordings")
def filter_alignable(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = lambda f: C.alignable(F.col("num_frames"), F.col("duration"), F.col("n_tokens"), f)
    return V.recordings(spark, sf_dir).select("recording_id", ok("prep").alias("prep"), ok("train").alias("train"))


@query("""WITH n AS (SELECT DISTINCT '/' || substr(doc_id::VARCHAR, 1, 2) AS needle FROM documents WHERE lang = 'de' UNION SELECT '/' || source || '/' || doc_id || '.' FROM documents WHERE doc_id % 7 = 0)
SELECT recording_id FROM recordings r WHERE NOT EXISTS (SELECT 1 FROM n WHERE contains(r.source_path, n.needle))""", "recordings")
def exclude_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths without any of a table of needles that grows with the documents."""
    d = V.table(spark, sf_dir, "documents")
    starts = d.where("lang = 'de'").select(F.concat(F.lit("/"), F.substring(F.col("doc_id").cast("string"), 1, 2)).alias("needle"))
    whole = d.where("doc_id % 7 = 0").select(F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".")))
    return C.exclude_source(V.recordings(spark, sf_dir), starts.union(whole)).select("recording_id")


@query("SELECT recording_id FROM recordings WHERE NOT contains(source_path, '/src1')", "recordings")
def exclude_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.exclude_source(V.recordings(spark, sf_dir), "/src1").select("recording_id")


@query("""SELECT count(*) AS total, count(*) FILTER (NOT (duration BETWEEN 1 AND 20) OR floor((floor((num_frames - 1) / 2) - 1) / 2) < n_tokens) AS removed,
  count(*) FILTER (NOT duration BETWEEN 1 AND 20) AS removed_duration,
  count(*) FILTER (duration BETWEEN 1 AND 20 AND floor((floor((num_frames - 1) / 2) - 1) / 2) < n_tokens) AS removed_tokens,
  round(count(*) FILTER (NOT (duration BETWEEN 1 AND 20) OR floor((floor((num_frames - 1) / 2) - 1) / 2) < n_tokens) / count(*) * 100, 3) AS percent FROM recordings""", "recordings")
def filter_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = ~C.alignable(F.col("num_frames"), F.col("duration"), F.col("n_tokens"), "prep")
    return C.filter_report(V.recordings(spark, sf_dir), {"duration": ~F.col("duration").between(1, 20), "tokens": short})


@query(r"""SELECT doc_id, upper(trim(regexp_replace(regexp_replace(regexp_replace(replace(text, 'ß', 'ss'), '\([^\)]*\)', ' ', 'g'), '^\.+|\.+$', '', 'g'), '[?!,.\s-]+', ' ', 'g'))) AS text FROM documents""")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.table(spark, sf_dir, "documents")
    return d.select("doc_id", X.normalize_text(F.replace("text", F.lit("ß"), F.lit("ss")), compose=True).alias("text"))


@query("SELECT doc_id, lower(text) AS lower_text, upper(replace(text, 'ß', 'ss')) AS upper_text FROM documents")
def case_folding(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.lower("text").alias("lower_text"), F.upper(F.replace("text", F.lit("ß"), F.lit("ss"))).alias("upper_text"))


@query("SELECT source_path, source || '-' || doc_id AS id, source AS speaker FROM recordings", "recordings")
def derive_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = V.recordings(spark, sf_dir).select("source_path", X.derive_id(F.col("source_path")).alias("id"))
    return rec.withColumn("speaker", X.speaker_of(F.col("id")))


@query("SELECT recording_id, '/data' || substr(source_path, 8) AS path FROM recordings", "recordings")
def remap_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.recordings(spark, sf_dir).select("recording_id", X.remap_prefix(F.col("source_path"), "/corpus", "/data").alias("path"))


@query("SELECT recording_id || tag AS recording_id, CAST(floor(num_samples / f + 0.5) AS BIGINT) AS num_samples, floor(num_samples / f + 0.5) / 16000::DOUBLE AS duration FROM recordings, (VALUES (1.0::DOUBLE, ''), (0.9::DOUBLE, '_sp0.9'), (1.1::DOUBLE, '_sp1.1')) AS k(f, tag)", "recordings")
def perturb_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.perturb_speed(V.recordings(spark, sf_dir)).select("recording_id", "num_samples", "duration")


@query("WITH r AS (SELECT user_id, event_type, ts, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) SELECT user_id, string_agg(event_type, ' ' ORDER BY ts, event_id) AS labels FROM r WHERE p IS NULL OR p <> event_type GROUP BY user_id")
def collapse_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"])
    seq = V.label_seq(spark, sf_dir).groupBy("user_id").agg(v.alias("v"))
    return seq.select("user_id", F.array_join(X.collapse_repeats(F.col("v")), " ").alias("labels"))


@query("""WITH r AS (SELECT user_id, event_type, ts, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, event_type FROM r WHERE p IS NULL OR p <> event_type""")
def collapse_repeats_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same labels, one row each: no user's labels are gathered."""
    return collapse_rows(V.label_seq(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type")


@query("""WITH s AS (SELECT recording_id, least(start + s.duration, r.duration) - start AS d, start, s.text, s.id FROM supervisions s JOIN (SELECT recording_id, duration FROM recordings) r USING (recording_id)),
g AS (SELECT recording_id, count(*) AS n, sum(d) AS total FROM s WHERE d > 0 GROUP BY recording_id)
SELECT r.recording_id || '-0' AS cut_id, coalesce(n, 0) AS n_supervisions, round(r.duration, 6) AS duration, round(coalesce(total, 0), 6) AS supervised FROM recordings r JOIN g USING (recording_id)""", "supervisions")
def build_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cuts_of(spark, sf_dir)
    total = F.aggregate("supervisions", F.lit(0.0), lambda a, s: a + s["duration"])
    return c.select("cut_id", F.size("supervisions").cast("long").alias("n_supervisions"), F.round("duration", 6).alias("duration"), F.round(total, 6).alias("supervised"))


@query("SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)")
def join_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = C.join_audio(V.table(spark, sf_dir, "documents").select("doc_id", "lang"), V.table(spark, sf_dir, "labels").select("doc_id", "quality"), ["doc_id"])
    return found.select("doc_id", "lang", F.col("quality").cast("int").alias("quality"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.join_audio(V.table(spark, sf_dir, "documents").select("doc_id", "lang"), V.table(spark, sf_dir, "labels").select("doc_id"), ["doc_id"])[1]


@query("SELECT id, round(least(s.start + s.duration, r.duration) - s.start, 6) AS duration FROM supervisions s JOIN recordings r USING (recording_id) WHERE least(s.start + s.duration, r.duration) - s.start > 0", "supervisions")
def fix_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, sup = C.fix_manifests(V.recordings(spark, sf_dir), V.supervisions(spark, sf_dir))
    return sup.select("id", F.round("duration", 6).alias("duration"))


@query("""WITH c AS (SELECT r.recording_id, r.duration, max(s.start + s.duration) AS last FROM recordings r LEFT JOIN supervisions s USING (recording_id) GROUP BY ALL)
SELECT 'duration' AS rule, recording_id || '-0' AS id FROM c WHERE duration <= 0 UNION ALL SELECT 'supervision outside', recording_id || '-0' FROM c WHERE last > duration + 0.002
UNION ALL SELECT 'amplitude', recording_id || '-0' FROM recordings WHERE doc_id % 50 = 0 OR abs(doc_id % 29 - 14) > 10""", "supervisions")
def validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples from -14 to 14, some without any."""
    samples = F.when(F.col("doc_id") % 100 == 50, F.array().cast("array<double>")).when(F.col("doc_id") % 50 != 0, F.array(F.lit(-0.5), (F.col("doc_id") % 29 - 14).cast("double")))
    rec = V.recordings(spark, sf_dir).select("recording_id", "duration", "sampling_rate", samples.alias("samples")).withColumn("channels", F.lit(1))
    return C.validate(C.build_cuts(rec, V.supervisions(spark, sf_dir)))


@query("SELECT recording_id || '-0' AS cut_id, 'pool=' || source || ';quality=' || quality AS custom FROM recordings JOIN labels USING (doc_id)", "recordings")
def attach_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = V.recordings(spark, sf_dir)
    c = rec.select(F.concat("recording_id", F.lit("-0")).alias("cut_id"), F.create_map(F.lit("pool"), "source", F.lit("quality"), F.lit("old")).alias("custom"))
    lab = V.table(spark, sf_dir, "labels").join(rec.select("doc_id", "recording_id"), "doc_id").select(F.concat("recording_id", F.lit("-0")).alias("cut_id"), F.col("quality").cast("string").alias("label"))
    done, _ = C.attach_labels(c, lab, "quality")
    return done.select("cut_id", F.concat(F.lit("pool="), F.col("custom")["pool"], F.lit(";quality="), F.col("custom")["quality"]).alias("custom"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.pending(V.table(spark, sf_dir, "documents"), V.table(spark, sf_dir, "labels"), ["doc_id"])


@query("""WITH s AS (SELECT recording_id, id, start, least(s.start + s.duration, r.duration) - s.start AS d FROM supervisions s JOIN (SELECT recording_id, duration FROM recordings) r USING (recording_id))
SELECT recording_id || '-0-' || (row_number() OVER (PARTITION BY recording_id ORDER BY start, id) - 1) AS cut_id, round(start, 6) AS start, round(d, 6) AS duration FROM s WHERE d > 0""", "supervisions")
def trim_to_supervisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.trim_to_supervisions(cuts_of(spark, sf_dir)).select("cut_id", F.round("start", 6).alias("start"), F.round("duration", 6).alias("duration"))


@query("SELECT role AS setting, count(*) AS n, CAST(sum(len(ref)) AS BIGINT) AS words FROM (SELECT c.role, list_filter(regexp_split_to_array(c.text, '[ \\t\\r\\n]+'), lambda w: w <> '') AS ref FROM conversations c) GROUP BY role")
def pair_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.pairs(spark, sf_dir)
    both, _ = C.pair_results(p.select("setting", "cut_id", "ref"), p.select("setting", "cut_id", "hyp"))
    return both.groupBy("setting").agg(F.count("*").alias("n"), F.sum(F.size("ref")).alias("words"))


@query(r"""WITH RECURSIVE b AS (SELECT list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda w: w <> '') AS w FROM benchmark),
p AS (SELECT DISTINCT array_to_string(list_slice(w, i, i + 2), ' ') AS phrase FROM (SELECT w, unnest(range(1, len(w) - 1)) AS i FROM b)),
d AS (SELECT doc_id AS utt_id, list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda w: w <> '') AS w FROM documents),
x AS (SELECT utt_id, i - 1 AS pos, array_to_string(list_slice(w, i, i + 2), ' ') AS phrase FROM (SELECT utt_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
h AS MATERIALIZED (SELECT utt_id, pos, phrase FROM x SEMI JOIN p USING (phrase)),
n AS MATERIALIZED (SELECT a.utt_id, a.pos, min(b.pos) AS next FROM h a JOIN h b ON b.utt_id = a.utt_id AND b.pos >= a.pos + 3 GROUP BY ALL),
g AS (SELECT utt_id, min(pos) AS pos FROM h GROUP BY utt_id UNION ALL SELECT n.utt_id, n.next FROM g JOIN n ON n.utt_id = g.utt_id AND n.pos = g.pos)
SELECT h.utt_id, CAST(h.pos AS INTEGER) AS pos, h.phrase FROM g JOIN h ON h.utt_id = g.utt_id AND h.pos = g.pos""")
def spot_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word windows of the benchmark texts in the whole documents."""
    b = V.table(spark, sf_dir, "benchmark").select(X.words(F.col("text")).alias("w"))
    win = F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.slice("w", i, F.lit(3)))
    phrases = b.where(F.size("w") >= 3).select(F.explode(win).alias("tokens")).distinct().withColumn("phrase", F.array_join("tokens", " "))
    docs = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("utt_id"), X.words(F.col("text")).alias("ys"))
    return C.spot_phrases(docs, phrases)


def _spotted(n: int) -> str:
    return f"""SELECT utt_id, i - 1 AS pos, {n} AS n, array_to_string(list_slice(w, i, i + {n - 1}), ' ') AS phrase, {" + ".join(f"pr[i + {k}]" for k in range(n))} AS total, bl[i + {n - 1}] AS after, len(w) AS size
  FROM (SELECT *, unnest(range(1, len(w) - {n - 2})) AS i FROM d)"""


@query(rf"""WITH RECURSIVE b AS (SELECT list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda w: w <> '') AS w FROM benchmark),
p AS ({" UNION ALL ".join(f"SELECT DISTINCT array_to_string(list_slice(w, i, i + {n - 1}), ' ') AS phrase, {n} AS n, {least}::DOUBLE AS least FROM (SELECT w, unnest(range(1, len(w) - {n - 2})) AS i FROM b)" for n, least in ((2, 0.25), (3, 0.5), (4, 0.375)))}),
d AS (SELECT utt_id, w, list_transform(range(1, len(w) + 1), lambda i: ((i * 37 + utt_id) % 64) / 64.0::DOUBLE) AS pr, list_transform(range(1, len(w) + 1), lambda i: (i * 31 + utt_id) % 4) AS bl
  FROM (SELECT doc_id AS utt_id, list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda w: w <> '') AS w FROM documents)),
x AS ({" UNION ALL ".join(map(_spotted, (2, 3, 4)))}),
q AS (SELECT x.utt_id, x.pos, max(x.n) AS n FROM x JOIN p USING (phrase, n) WHERE total / x.n >= least AND (x.pos + x.n = size OR after > 0) GROUP BY x.utt_id, x.pos),
h AS MATERIALIZED (SELECT q.utt_id, q.pos, q.n, x.phrase FROM q JOIN x ON x.utt_id = q.utt_id AND x.pos = q.pos AND x.n = q.n),
s AS MATERIALIZED (SELECT a.utt_id, a.pos, min(b.pos) AS next FROM h a JOIN h b ON b.utt_id = a.utt_id AND b.pos >= a.pos + a.n GROUP BY ALL),
g AS (SELECT utt_id, min(pos) AS pos FROM h GROUP BY utt_id UNION ALL SELECT s.utt_id, s.next FROM g JOIN s ON s.utt_id = g.utt_id AND s.pos = g.pos)
SELECT h.utt_id, CAST(h.pos AS INTEGER) AS pos, h.phrase FROM g JOIN h ON h.utt_id = g.utt_id AND h.pos = g.pos""")
def spot_phrases_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two, three and four words of the benchmark texts, each length with its own threshold, over probabilities and blank counts."""
    b = V.table(spark, sf_dir, "benchmark").select(X.words(F.col("text")).alias("w"))
    windows = lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.slice("w", i, F.lit(n)))
    some = [b.where(F.size("w") >= n).select(F.explode(windows(n)).alias("tokens")).distinct().withColumn("threshold", F.lit(least)) for n, least in ((2, 0.25), (3, 0.5), (4, 0.375))]
    phrases = some[0].unionByName(some[1]).unionByName(some[2]).withColumn("phrase", F.array_join("tokens", " "))
    docs = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("utt_id"), X.words(F.col("text")).alias("ys"))
    probs = F.transform("ys", lambda _, i: ((i + 1) * 37 + F.col("utt_id")) % 64 / 64.0)
    return C.spot_phrases(docs.withColumn("probs", probs).withColumn("trailing", F.transform("ys", lambda _, i: (((i + 1) * 31 + F.col("utt_id")) % 4).cast("int"))), phrases, blanks=0)


HASH = "CAST('0x' || substr(md5(recording_id || ':0:{}'), 1, 8) AS BIGINT)"


@query(f"""WITH n AS (SELECT recording_id AS noise_id, row_number() OVER (ORDER BY recording_id) - 1 AS k, count(*) OVER () AS size FROM recordings WHERE lang = 'de'),
c AS (SELECT recording_id AS cut_id, {HASH.format("whether")} / 4294967296.0::DOUBLE < 0.5 AS mixed, {HASH.format("which")} % (SELECT count(*) FROM n) AS k, 10 + 10 * ({HASH.format("snr")} / 4294967296.0::DOUBLE) AS snr FROM recordings)
SELECT cut_id, CASE WHEN mixed THEN noise_id END AS noise_id, CASE WHEN mixed THEN round(snr, 6) END AS snr FROM c LEFT JOIN n USING (k)""", "recordings")
def noise_mix_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = V.recordings(spark, sf_dir).select(F.col("recording_id").alias("cut_id"), "lang")
    return C.noise_mix_plan(rec, rec.where("lang = 'de'")).withColumn("snr", F.round("snr", 6))


def manifest_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cut manifest: each document as a cut with one supervision."""
    sup = F.array(F.struct(F.col("recording_id").alias("id"), "recording_id", F.lit(0.0).alias("start"), "duration", F.lit(0).alias("channel"), F.col("lang").alias("language"), F.col("source").alias("speaker"), "text"))
    return V.recordings(spark, sf_dir).select(F.concat("recording_id", F.lit("-0")).alias("id"), F.lit(0.0).alias("start"), "duration", F.lit(0).alias("channel"), sup.alias("supervisions"), F.create_map(F.lit("pool"), "source").alias("custom"), "source")


@query("SELECT recording_id || '-0' AS id, duration, source AS pool, md5(text) AS text FROM recordings", "recordings")
def manifest_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts written as gzip JSON lines and read back under the declared schema."""
    path = shared_path(spark, "manifest")
    M.write_manifest(manifest_cuts(spark, sf_dir).drop("source"), path)
    back = M.read_manifest(spark, path, "cuts").where("corrupt is null")
    return back.select("id", "duration", F.col("custom")["pool"].alias("pool"), F.md5(F.get("supervisions", F.lit(0))["text"].cast("binary")).alias("text"))


SHARDS = """s AS (SELECT recording_id || '-0' AS id, 'ssl_' || source AS pool, lpad(CAST(doc_id % 2 AS VARCHAR), 8, '0') AS shard FROM recordings)"""


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard files by pool, two versions of labels; the newer one read back."""
    path = shared_path(spark, "shards")
    c = manifest_cuts(spark, sf_dir).withColumn("pool", F.concat(F.lit("ssl_"), "source"))
    c = c.withColumn("shard", F.lpad((F.substring_index(F.substring_index("id", "-", 2), "-", -1).cast("long") % 2).cast("string"), 8, "0")).drop("source")
    M.write_named_shards(c, path, suffix="_k1")
    return M.read_shards(spark, path, "ssl_", "_k1")


@query("""SELECT coalesce(source, 'none') || '-' || doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 8000 ELSE 16000 END AS sampling_rate, CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 1 END AS channels,
  CAST(strlen(text) // CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 1 END AS BIGINT) AS num_samples,
  (strlen(text) // CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 1 END) / CASE WHEN doc_id % 3 = 0 THEN 8000.0::DOUBLE ELSE 16000.0::DOUBLE END AS duration FROM documents""")
def audio_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A WAV file per document (its bytes as 8-bit samples; every tenth with the text as metadata in front), found again by its header."""
    path = shared_path(spark, "audio")
    d = V.table(spark, sf_dir, "documents")
    rate, channels = F.when(F.col("doc_id") % 3 == 0, 8000).otherwise(16000), F.when(F.col("doc_id") % 4 == 0, 2).otherwise(1)
    rows = d.select(F.concat_ws("/", F.coalesce("source", F.lit("none")), F.col("doc_id").cast("string")).alias("id"), rate.alias("sampling_rate"), channels.alias("channels"), F.lit(8).alias("bits"), F.col("text").cast("binary").alias("data"), F.when(F.col("doc_id") % 10 == 0, F.col("text")).alias("comment"))
    M.write_audio(rows, path)
    return M.audio_index(spark, path)[0].drop("path")


@query(f"WITH {SHARDS} SELECT id, pool, shard FROM s", "recordings")
def read_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(spark, sf_dir).select("id", "pool", "shard")


@query(f"WITH {SHARDS} SELECT key, row_number() OVER (ORDER BY md5(key || ':142'), key) AS shard_order, n FROM (SELECT pool || '.' || shard AS key, count(*) AS n FROM s GROUP BY 1)", "recordings")
def shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = shards(spark, sf_dir).select("id", F.concat_ws(".", "pool", "shard").alias("key"))
    return M.shuffle_shards(read, 142, "key").groupBy("key", "shard_order").agg(F.count("*").alias("n"))


@query("SELECT recording_id, duration FROM recordings", "recordings")
def write_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second write finds the first one's marker and leaves it."""
    path, rec = shared_path(spark, "prepared"), V.recordings(spark, sf_dir).select("recording_id", "duration")
    M.write_if_absent(rec, path)
    M.write_if_absent(rec.where("duration < 0"), path)
    return spark.read.parquet(path)


@query("""SELECT setting, cut_id || ':\tref=' || CAST(to_json(ref) AS VARCHAR) AS value FROM pairs
UNION ALL SELECT setting, cut_id || ':\thyp=' || CAST(to_json(list_transform(list_filter(list_transform(ref, lambda x, i: {'w': x, 'i': i}), lambda z: z.i % 7 <> 0), lambda z: CASE WHEN z.i % 11 = 0 THEN 'x' ELSE z.w END)) AS VARCHAR) FROM pairs""", "pairs")
def write_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recognition files of every setting, read back."""
    path = shared_path(spark, "results")
    M.write_results(V.pairs(spark, sf_dir), path)
    return spark.read.text(f"{path}/recogs").select("setting", "value")


@query("SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def common_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return C.common_ids([d, V.table(spark, sf_dir, "labels"), d.where("lang = 'en'")], "doc_id").select("doc_id")


@query("SELECT recording_id FROM (SELECT recording_id, row_number() OVER (ORDER BY recording_id) - 1 AS k FROM recordings) WHERE k >= 100 AND k < 350", "recordings")
def index_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.index_range(V.recordings(spark, sf_dir).select("recording_id"), 100, 350, ["recording_id"]).select("recording_id")


@query("""WITH e AS (SELECT recording_id, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY start_ms, event_id) - 1 AS BIGINT) AS seg_idx, start_ms, end_ms FROM vad) SELECT recording_id, seg_idx, start_ms, end_ms FROM e""", "vad")
def assemble_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every odd segment comes as an opening and, in the next chunk, a closing."""
    return S.assemble_segments(segment_events(spark, sf_dir))


def segment_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    v = V.vad(spark, sf_dir).withColumn("k", F.row_number().over(W.partitionBy("recording_id").orderBy("start_ms", "event_id")))
    whole = F.array(F.struct((2 * F.col("k")).alias("chunk"), F.lit(0).alias("item"), F.col("start_ms"), F.col("end_ms")))
    minus = F.lit(-1).cast("long")
    halves = F.array(F.struct((2 * F.col("k")).alias("chunk"), F.lit(0).alias("item"), F.col("start_ms"), minus.alias("end_ms")), F.struct((2 * F.col("k") + 1).alias("chunk"), F.lit(0).alias("item"), minus.alias("start_ms"), F.col("end_ms")))
    return v.select("recording_id", F.explode(F.when(F.col("k") % 2 == 1, halves).otherwise(whole)).alias("x")).select("recording_id", "x.*")


@query("""WITH RECURSIVE o AS (SELECT recording_id, start_ms AS s, end_ms AS e, row_number() OVER (PARTITION BY recording_id ORDER BY start_ms, end_ms) AS k, count(*) OVER (PARTITION BY recording_id) AS n FROM vad),
f AS (SELECT recording_id, k, n, s AS cs, e AS ce, CAST(NULL AS BIGINT) AS os, CAST(NULL AS BIGINT) AS oe FROM o WHERE k = 1
  UNION ALL SELECT o.recording_id, o.k, o.n, CASE WHEN ce - cs > 10000 OR o.s - ce > 5000 THEN o.s ELSE cs END, o.e,
    CASE WHEN ce - cs > 10000 OR (o.s - ce > 5000 AND ce - cs > 2000) THEN cs END, CASE WHEN ce - cs > 10000 OR (o.s - ce > 5000 AND ce - cs > 2000) THEN ce END
  FROM f JOIN o ON o.recording_id = f.recording_id AND o.k = f.k + 1),
m AS (SELECT recording_id, os AS start_ms, oe AS end_ms FROM f WHERE os IS NOT NULL UNION ALL SELECT recording_id, cs, ce FROM f WHERE k = n AND ce - cs > 2000)
SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY start_ms) - 1 AS seg_idx, start_ms, end_ms FROM m""", "vad")
def merge_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.merge_segments(V.vad(spark, sf_dir))


@query("""WITH v AS (SELECT recording_id, event_id AS seg_idx, start_ms * 16 AS a, end_ms * 16 AS b FROM vad WHERE end_ms > start_ms),
s AS (SELECT *, CASE WHEN b - a > 480000 THEN CAST(ceil((b - a) / round_even((b - a) / 480000, 0)) AS BIGINT) ELSE b - a END AS step FROM v),
p AS (SELECT *, unnest(range(a, b, step)) AS lo FROM s)
SELECT recording_id, seg_idx, CAST((lo - a) // step AS BIGINT) AS part, seg_idx || '-' || ((lo - a) // step) AS name, lo AS start_sample, least(lo + step, b) AS end_sample FROM p""", "vad")
def split_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.split_segments(V.vad(spark, sf_dir).withColumnRenamed("event_id", "seg_idx"))


@query("SELECT recording_id, CASE WHEN duration <= 30 THEN CASE WHEN duration <= 2 THEN 'drop' ELSE 'copy' END ELSE 'segment' END AS action FROM recordings", "recordings")
def route_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.route_recordings(V.recordings(spark, sf_dir)).select("recording_id", "action")


@query("SELECT event_id, CAST(round_even(value / 0.01::DOUBLE, 0) AS BIGINT) AS frame, CAST(round_even(floor(value * 100) * 0.5, 0) AS BIGINT) AS label_at FROM events")
def to_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.table(spark, sf_dir, "events")
    return e.select("event_id", X.to_frames(F.col("value")).alias("frame"), X.half_even(F.floor(F.col("value") * 100) * 0.5).alias("label_at"))


@query("""SELECT conv_id AS cut_id, string_agg(role || ':' || CAST(round_even(turn * 0.125 / 0.01::DOUBLE, 0) AS BIGINT) || '-' || CAST(round_even((turn * 0.125 + 0.0625) / 0.01::DOUBLE, 0) AS BIGINT), ' ' ORDER BY turn, role) AS spans FROM conversations GROUP BY conv_id""")
def align_to_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.table(spark, sf_dir, "conversations")
    w = F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("symbol"), (F.col("turn") * 0.125).alias("start"), (F.col("turn") * 0.125 + 0.0625).alias("end"))))
    sup = F.array(F.struct(F.create_map(F.lit("word"), w).alias("alignment")))
    a = S.align_to_frames(c.groupBy(F.col("conv_id").alias("cut_id")).agg(sup.alias("supervisions")))
    spans = F.transform(F.arrays_zip("words", "starts", "ends"), lambda x: F.concat(x["words"], F.lit(":"), x["starts"].cast("string"), F.lit("-"), x["ends"].cast("string")))
    return a.select("cut_id", F.array_join(spans, " ").alias("spans"))


@query("WITH s AS (SELECT recording_id, num_frames, unnest(range(0, num_frames + 13, 32)) AS start FROM recordings WHERE num_frames > 0) SELECT recording_id, start // 32 AS chunk, start, least(num_frames + 13 - start, 45) AS length FROM s", "recordings")
def chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.chunk_plan(V.recordings(spark, sf_dir)).select("recording_id", *LONG("chunk", "start", "length"))


@query("""SELECT source, lang, count(*) AS n, round(sum(duration) / 3600, 6) AS hours, round(avg(duration), 6) AS mean, round(quantile_cont(duration, 0.25), 6) AS p25, round(quantile_cont(duration, 0.5), 6) AS p50, round(quantile_cont(duration, 0.75), 6) AS p75
FROM recordings GROUP BY ROLLUP (source, lang)""", "recordings")
def duration_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = C.duration_stats(V.recordings(spark, sf_dir), ["source", "lang"])
    return t.select("source", "lang", "n", *[F.round(c, 6).alias(c) for c in ("hours", "mean", "p25", "p50", "p75")])


@query("SELECT recording_id, CAST((row_number() OVER (ORDER BY recording_id) - 1) % 8 AS BIGINT) AS rank FROM recordings", "recordings")
def stripe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.stripe(V.recordings(spark, sf_dir).select("recording_id"), 8, ["recording_id"]).select("recording_id", "rank")


@query("WITH r AS (SELECT recording_id, num_frames * 10 AS ms, sum(num_frames * 10) OVER (ORDER BY recording_id ROWS UNBOUNDED PRECEDING) AS upto FROM recordings) SELECT recording_id, ms FROM r WHERE upto <= 3600000", "recordings")
def take_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = V.recordings(spark, sf_dir).select("recording_id", (F.col("num_frames") * 10).alias("ms"))
    return C.take_duration(r, 1.0, ["recording_id"], "ms")


@query("""WITH p AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) AS epoch, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents, count(*) AS frames FROM orders GROUP BY 1),
q AS (SELECT CAST(epoch AS BIGINT) AS epoch, frames, round(cents / 100.0::DOUBLE / frames, 6) AS per_frame FROM p),
b AS (SELECT *, min(per_frame) OVER (ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS best FROM q)
SELECT epoch, CAST(frames AS BIGINT) AS frames, per_frame, best, (SELECT min(x.epoch) FROM q x WHERE x.per_frame = b.best AND x.epoch <= b.epoch) AS best_epoch FROM b""")
def metric_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = V.table(spark, sf_dir, "orders")
    log = o.select((F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("epoch"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    log = log.groupBy("epoch").agg((F.sum("cents") / 100.0).alias("loss"), F.count("*").alias("frames"))
    return C.metric_rollup(log)


@query("""SELECT masked, count(*) FILTER (list_position(logits, list_max(logits)) - 1 = target AND list_position(logits, list_min(logits)) - 1 <> target) AS correct, count(*) AS frames FROM logits GROUP BY masked""", "logits")
def frame_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.frame_accuracy(V.logits(spark, sf_dir))
