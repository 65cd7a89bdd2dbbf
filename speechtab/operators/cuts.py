"""Filters, joins, repairs and validation of recordings, supervisions and cuts."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from speechtab.operators.patterns import NONE, Automaton, code_points, parts
from speechtab.session import bounded

#: Named duration bands in seconds, both ends included.
BANDS = {"prep": (1.0, 20.0), "train": (1.0, 16.0), "decode": (0.0, 30.0)}


def ssl_band(min_keep: int, max_keep: int, rate: int) -> tuple[float, float]:
    return min_keep / rate, min(max_keep / rate, 30.0)


def filter_duration(df: DataFrame, lo: float = 1.0, hi: float = 20.0) -> DataFrame:
    return df.where(F.col("duration").between(lo, hi))


def frames_after(frames: Column, formula: str) -> Column:
    """Frames left after subsampling; floors, also of negative numbers."""
    if formula == "prep":
        return F.floor((F.floor((frames - 1) / 2) - 1) / 2)
    return F.floor((F.floor((frames - 7) / 2) + 1) / 2)


def alignable(num_frames: Column, duration: Column, n_tokens: Column, formula: str) -> Column:
    return frames_after(F.coalesce(num_frames.cast("double"), duration * 100), formula) >= n_tokens


def filter_alignable(df: DataFrame, formula: str = "train", tokens: str = "n_tokens") -> DataFrame:
    """Rows with at least as many frames after subsampling as tokens."""
    return df.where(alignable(F.col("num_frames"), F.col("duration"), F.col(tokens), formula))


def exclude_source(df: DataFrame, needles: DataFrame | str, path: str = "source_path") -> DataFrame:
    """Rows whose path holds none of the needles: a string, or a table (needle) of any size.

    A table of needles is searched for by automata of bounded size, each in one pass over the rows where they lie (no join, no shuffle).
    Null paths hold nothing and stay; null needles are none; an empty needle is in every path that is not null. Repeated needles count once, and an empty table of them
    removes nothing.
    """
    if isinstance(needles, str):
        return df.where(~F.coalesce(F.contains(F.col(path), F.lit(needles)), F.lit(False)))
    some = needles.select("needle").where("needle is not null").distinct()
    at, names = df.columns.index(path), df.columns
    if some.where("needle = ''").limit(1).count():
        return df.where(F.col(f"`{path}`").isNull())
    for part in parts(some, F.col("needle"), F.length("needle")):
        symbols, offsets = code_points([r["needle"] for r in part])
        shared = df.sparkSession.sparkContext.broadcast(Automaton(np.split(symbols, offsets[1:-1])))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hits, _, _ = shared.value.find(*code_points(b.column(at).to_pylist()))
                keep = np.ones(len(b), bool)
                keep[hits] = False
                yield b.filter(pa.array(keep))

        plain = df.toDF(*[f"c{i}" for i in range(len(names))])  # names may clash
        df = plain.mapInArrow(run, plain.schema).toDF(*names)
    return df


def common_ids(parts: list[DataFrame], key: str = "id") -> DataFrame:
    """The rows of the first part whose id every other part has too."""
    first, *others = parts
    for other in others:
        first = first.join(other.select(key).distinct(), key, "left_semi")
    return first


def filter_report(df: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """One pass: total, removed rows by the first reason that holds, and percents (null of no rows)."""
    first = F.coalesce(*[F.when(c, F.lit(name)) for name, c in reasons.items()])
    tagged = df.select(first.alias("reason"))
    counts = [F.count_if(F.col("reason") == name).alias(f"removed_{name}") for name in reasons]
    t = tagged.agg(F.count("*").alias("total"), F.count("reason").alias("removed"), *counts)
    return t.withColumn("percent", F.when(F.col("total") > 0, F.round(F.col("removed") / F.col("total") * 100, 3)))


def perturb_speed(df: DataFrame, factors: tuple[float, ...] = (1.0, 0.9, 1.1)) -> DataFrame:
    """One row per factor by one scan; samples, durations and starts rescaled, ids marked ``_sp<f>``."""
    f = F.col("factor")
    rows = df.withColumn("factor", F.explode(F.array(*[F.lit(float(x)) for x in factors])))
    tag = F.create_map(*[x for k in factors for x in (F.lit(float(k)), F.lit("" if k == 1 else f"_sp{k:g}"))])
    samples = F.floor(F.col("num_samples") / f + 0.5).cast("long")
    rows = rows.withColumn("recording_id", F.concat("recording_id", tag[f])).withColumn("num_samples", samples)
    rows = rows.withColumn("duration", F.col("num_samples") / F.col("sampling_rate"))
    for c in ("start", "sup_duration"):
        if c in df.columns:
            rows = rows.withColumn(c, F.col(c) / f)
    return rows


def build_cuts(recordings: DataFrame, supervisions: DataFrame) -> DataFrame:
    """One cut per recording and channel with its supervisions nested; recordings without any keep an empty array."""
    fields = [c for c in ("start", "id", "duration", "channel", "language", "speaker", "text") if c in supervisions.columns]
    nested = supervisions.groupBy("recording_id", "channel").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("supervisions"))
    channels = recordings.withColumn("channel", F.explode(F.sequence(F.lit(0), F.col("channels") - 1))) if "channels" in recordings.columns else recordings.withColumn("channel", F.lit(0))
    cuts = channels.join(nested, ["recording_id", "channel"], "left")
    empty = F.array().cast(nested.schema["supervisions"].dataType)
    return cuts.withColumn("supervisions", F.coalesce("supervisions", empty)).withColumn("cut_id", F.concat_ws("-", "recording_id", "channel")).withColumn("start", F.lit(0.0))


def join_audio(transcripts: DataFrame, audio: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Transcript lines with their audio file, and the lines whose file is missing."""
    return transcripts.join(audio, on), transcripts.join(audio, on, "left_anti")


def fix_manifests(recordings: DataFrame, supervisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Orphans leave on both sides; supervisions are clipped to their recording, and leave where nothing remains."""
    ends = recordings.select("recording_id", F.col("duration").alias("__whole"))
    kept = supervisions.join(ends, "recording_id").withColumn("duration", F.least(F.col("start") + F.col("duration"), "__whole") - F.col("start"))
    kept = kept.where("duration > 0").drop("__whole")
    return recordings.join(kept.select("recording_id").distinct(), "recording_id", "left_semi"), kept


def validate(cuts: DataFrame, rate: int = 16_000, tolerance: float = 0.002, amplitude: float = 10.0) -> DataFrame:
    """(rule, id) of every violation: repeated ids, durations, rate, channels, supervisions outside their cut.

    With a column ``samples`` also amplitude: no samples, one that is null or NaN, or one beyond +-``amplitude`` (samples of 16-bit files that nobody scaled lie far
    beyond, clipped ones a little beyond 1 do not).
    """
    repeated = cuts.groupBy("cut_id").count().where("count > 1").select(F.lit("repeated id").alias("rule"), F.col("cut_id").alias("id"))
    outside = F.exists("supervisions", lambda s: (s["start"] < -tolerance) | (s["start"] + s["duration"] > F.col("duration") + tolerance))
    rules = {
        "duration": F.coalesce(F.col("duration") <= 0, F.lit(True)),
        "sampling rate": ~F.col("sampling_rate").eqNullSafe(rate),
        "channels": ~F.col("channels").eqNullSafe(1),
        "supervision outside": F.coalesce(outside, F.lit(False)),
    }
    if "samples" in cuts.columns:
        rules["amplitude"] = F.coalesce(F.exists("samples", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > amplitude)) | (F.size("samples") == 0), F.lit(True))
    tags = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]), lambda x: x.isNotNull())
    return cuts.select(F.explode(tags).alias("rule"), F.col("cut_id").alias("id")).unionByName(repeated)


def attach_labels(cuts: DataFrame, labels: DataFrame, key: str = "kmeans") -> tuple[DataFrame, DataFrame]:
    """Cuts with ``custom[key]`` set from labels (cut_id, label); the second table holds cuts without one.

    Other custom keys stay.
    """
    joined = cuts.join(labels.select("cut_id", F.col("label").alias("__label")), "cut_id", "left")
    old = F.coalesce("custom", F.create_map().cast("map<string,string>"))
    new = F.map_concat(F.map_filter(old, lambda k, _: k != key), F.create_map(F.lit(key), "__label"))
    return joined.where("__label is not null").withColumn("custom", new).drop("__label"), joined.where("__label is null").select("cut_id")


def pending(tasks: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Tasks, as a set, that are not done."""
    return tasks.select(*on).distinct().join(done, on, "left_anti")


def trim_to_supervisions(cuts: DataFrame) -> DataFrame:
    """One cut per supervision, starting with it; cuts without supervisions go."""
    rows = cuts.select("*", F.posexplode("supervisions").alias("__i", "s")).drop("supervisions")
    return (
        rows.withColumn("cut_id", F.concat_ws("-", "cut_id", "__i"))
        .withColumn("start", F.col("start") + F.col("s.start"))
        .withColumn("duration", F.col("s.duration"))
        .withColumn("supervision", F.col("s").withField("start", F.lit(0.0)))
        .drop("__i", "s")
    )


def pair_results(ref: DataFrame, hyp: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(setting, cut_id, ref, hyp), and the one-sided rows."""
    both = ref.withColumn("__r", F.lit(True)).join(hyp.withColumn("__h", F.lit(True)), ["setting", "cut_id"], "full")
    ok = F.col("__r").isNotNull() & F.col("__h").isNotNull()
    side = F.when(F.col("__r").isNull(), "reference").otherwise("hypothesis")
    return both.where(ok).drop("__r", "__h"), both.where(~ok).select("setting", "cut_id", side.alias("missing"))


def greedy_spots(spots: list[tuple]) -> Iterator[tuple]:
    """Of (pos, length, phrase) those left to right, longest first, that do not overlap; equal ones by phrase."""
    free = 0
    for pos, n, phrase in sorted(spots, key=lambda x: (x[0], -x[1], x[2])):
        if pos >= free:
            free = pos + n
            yield pos, n, phrase


def spot_phrases(tokens: DataFrame, phrases: DataFrame, threshold: float = 0.0, blanks: int = -1) -> DataFrame:
    """(utt_id, pos, phrase): non-overlapping phrases over ``tokens`` (utt_id, ys, probs, trailing).

    A phrase counts where the mean of its token probabilities reaches the threshold (the phrase's own, if ``phrases`` (phrase, tokens) has a column threshold that is
    not null) and more than ``blanks`` blanks follow it (the utterance's end waives that). Left to right, longest first; of phrases with the same tokens the first by name among those that count.
    All phrases are found in one pass by an automaton where the tokens lie. Where the phrases need several automata, their finds meet by utterance.
    Without ``probs`` and ``trailing`` both tests pass; a missing probability or blank count fails. Null and empty phrases, and those with a null token, are none; null ``ys`` hold none; null tokens match nothing.
    """
    own = F.col("threshold").cast("double") if "threshold" in phrases.columns else F.lit(None).cast("double")
    known = phrases.select("phrase", "tokens", F.coalesce(own, F.lit(float(threshold))).alias("least")).where((F.size("tokens") > 0) & ~F.exists("tokens", lambda t: t.isNull()) & F.col("phrase").isNotNull())
    given = [c for c in ("probs", "trailing") if c in tokens.columns]
    lists = list(parts(known.distinct(), F.col("tokens"), F.size("tokens")))
    id_type, kind = tokens.schema["utt_id"].dataType.simpleString(), pa.string() if tokens.schema["ys"].dataType.elementType.typeName() == "string" else pa.int64()
    out = f"utt_id {id_type}, pos int, n int, phrase string"
    finds = []
    for part in lists:
        vocab = {t: i for i, t in enumerate(sorted({t for r in part for t in r["tokens"]}))}
        named: dict[tuple, list] = {}
        for r in part:
            named.setdefault(tuple(r["tokens"]), []).append((r["phrase"], r["least"]))
        machine = Automaton([np.array([vocab[t] for t in k], np.int64) for k in named])
        shared = tokens.sparkSession.sparkContext.broadcast((machine, pa.array(list(vocab), kind), [sorted(v) for v in named.values()]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, whole=len(lists) == 1) -> Iterator[pa.RecordBatch]:
            machine, words, names = shared.value
            for b in batches:
                ys = b.column(1)
                offsets = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(ys), 0).to_numpy())).astype(np.int64)
                symbols = pc.fill_null(pc.index_in(ys.flatten().cast(kind), words), NONE).to_numpy()
                row, pos, which = machine.find(symbols, offsets)
                order = np.argsort(row, kind="stable")
                rows: list[tuple] = []
                cut = np.searchsorted(row[order], np.unique(row))
                for group in np.split(order, cut[1:]) if len(order) else []:
                    i = int(row[group[0]])
                    extra = [b.column(2 + k)[i].as_py() for k in range(len(given))]
                    probs, trailing = (extra[given.index(c)] or [] if c in given else None for c in ("probs", "trailing"))
                    size, spots = int(offsets[i + 1] - offsets[i]), []
                    for at, w in zip(pos[group].tolist(), which[group].tolist()):
                        n = int(machine.sizes[w])
                        end = at + n
                        if trailing is not None and end < size and not (len(trailing) >= end and trailing[end - 1] is not None and trailing[end - 1] > blanks):
                            continue
                        mean = None if probs is None else sum(probs[at:end]) / n if len(probs) >= end and None not in probs[at:end] else -math.inf
                        spots += [(at, n, name) for name, least in names[w] if mean is None or mean >= least]
                    rows += [(i, *s) for s in (greedy_spots(spots) if whole else spots)]
                cols = list(zip(*rows)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string())], ["utt_id", "pos", "n", "phrase"])

        finds.append(tokens.select("utt_id", "ys", *given).mapInArrow(run, out))
    if not finds:
        return tokens.sparkSession.createDataFrame([], out).drop("n")
    if len(finds) == 1:
        return finds[0].drop("n")

    def choose(found: pd.DataFrame) -> pd.DataFrame:
        best = list(greedy_spots(list(zip(found["pos"], found["n"], found["phrase"]))))
        return pd.DataFrame({"utt_id": found["utt_id"].iloc[: len(best)].to_numpy(), "pos": [x[0] for x in best], "n": [x[1] for x in best], "phrase": [x[2] for x in best]})

    return reduce(DataFrame.unionByName, finds).groupBy("utt_id").applyInPandas(choose, out).drop("n")


def noise_mix_plan(cuts: DataFrame, noise: DataFrame, p: float = 0.5, snr: tuple[float, float] = (10.0, 20.0), seed: int = 0) -> DataFrame:
    """(cut_id, noise_id, snr): seeded hashes choose whether, which noise cut and how loud; ids stay.

    ``noise`` has consecutive numbers from its ids' order; it is broadcast when small. Without noise no cut is mixed.
    """
    from speechtab.operators.batching import seeded
    from speechtab.sources.manifests import indexed

    numbered = indexed(noise.select(F.col("cut_id").alias("noise_id")), ["noise_id"], "__k")
    n = numbered.count()
    draw = lambda salt: seeded("cut_id", seed, salt) / 4294967296.0
    chosen = cuts.select("cut_id", (F.lit(bool(n)) & (draw("whether") < p)).alias("mixed"), F.pmod(seeded("cut_id", seed, "which"), F.lit(max(1, n))).alias("__k"), (snr[0] + (snr[1] - snr[0]) * draw("snr")).alias("snr"))
    with_noise = chosen.where("mixed").join(bounded(numbered), "__k").select("cut_id", "noise_id", "snr")
    return with_noise.unionByName(chosen.where(~F.col("mixed")).select("cut_id", F.lit(None).cast("string").alias("noise_id"), F.lit(None).cast("double").alias("snr")))


def duration_stats(df: DataFrame, by: list[str]) -> DataFrame:
    """Count, hours, mean and quartiles of durations for each of ``by`` and over all (rolled up)."""
    q = lambda p: F.percentile("duration", F.lit(p))
    return df.rollup(*by).agg(F.count("*").alias("n"), (F.sum("duration") / 3600).alias("hours"), F.avg("duration").alias("mean"), q(0.25).alias("p25"), q(0.5).alias("p50"), q(0.75).alias("p75"))


def stripe(df: DataFrame, world: int, order: list) -> DataFrame:
    """``df`` with ``rank``: rows dealt in turn, by their place in the order, to ``world`` workers."""
    from speechtab.sources.manifests import indexed

    return indexed(df, order).withColumn("rank", F.col("idx") % world)


def index_range(df: DataFrame, start: int, stop: int, order: list) -> DataFrame:
    """The rows whose place in the order is start..stop - 1, with ``idx``; a range past the end is short or empty."""
    from speechtab.sources.manifests import indexed

    return indexed(df, order).where((F.col("idx") >= start) & (F.col("idx") < stop))


def take_duration(df: DataFrame, hours: float, order: list, millis: str = "duration_ms") -> DataFrame:
    """Rows in order while the running duration stays within ``hours``; per-partition sums, then offsets."""
    from speechtab.session import checkpointed

    part = checkpointed(df.orderBy(*order).withColumn("__part", F.spark_partition_id()))
    upto = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = part.groupBy("__part").agg(F.sum(millis).alias("__n")).withColumn("__start", F.coalesce(F.sum("__n").over(upto), F.lit(0))).drop("__n")
    within = F.sum(millis).over(W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    rows = part.withColumn("__sum", within).join(bounded(starts), "__part")
    return rows.where(F.col("__start") + F.col("__sum") <= int(hours * 3_600_000)).drop("__part", "__sum", "__start")


def metric_rollup(log: DataFrame) -> DataFrame:
    """Loss per frame of each epoch, the best so far and its epoch; ties keep the first."""
    per = log.groupBy("epoch").agg(F.sum("loss").alias("loss"), F.sum("frames").alias("frames")).withColumn("per_frame", F.round(F.col("loss") / F.col("frames"), 6))
    best = F.min(F.struct("per_frame", "epoch")).over(W.orderBy("epoch").rowsBetween(W.unboundedPreceding, 0))
    return per.withColumn("b", best).select("epoch", "frames", "per_frame", F.col("b.per_frame").alias("best"), F.col("b.epoch").alias("best_epoch"))


def frame_accuracy(frames: DataFrame, by: str = "masked") -> DataFrame:
    """Counts of frames (logits, target) whose largest logit is the target's and smallest is not, by mask."""
    at = lambda f: F.array_position("logits", f("logits")) - 1
    hit = (at(F.array_max) == F.col("target")) & (at(F.array_min) != F.col("target"))
    return frames.groupBy(by).agg(F.count_if(hit).alias("correct"), F.count("*").alias("frames"))
