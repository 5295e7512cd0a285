"""Queries of the numpy kernels, resampling and streaming, most checked against brute force in the tests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import SpikeConfig
from ..functions import cluster1d, gaussian, registry, signals, spectra, spikefit
from ..functions import models as m
from ..operators import ranks, spikes
from ..scratch import folder
from ..streaming import operators as streaming
from .base import events, table, waveforms

DAY = 86_400_000_000


def r6(c):
    return F.round(c, 6)


#: For sample previews, in preview steps: six samples on either side of a peak above the resting level.
PREVIEW = SpikeConfig(window_ms=(6.0, 6.0), threshold=-60.0, refractory_ms=3.0, pre_inflection_ms=3.0)
#: One preview step counts as a millisecond of PREVIEW.
STEP_FS = 1_000.0


def _previews(s, d):
    """The previews of all recordings as joined chunks, samples numbered in preview steps.

    Every chunk of a recording spans the same time and is thinned to the same number of samples; ``step_us``
    is the time between two of them.
    """
    r = table(s, d, "recordings").filter("recording_id is not null and chunk_id is not null")
    about = r.groupBy("recording_id").agg(F.coalesce(F.max(F.when(F.col("samples").isNotNull(), F.size("samples"))), F.lit(0)).alias("k"), (F.max("chunk_id") + 1).alias("chunks"), F.max("duration_ms").alias("ms"))
    about = about.filter("k > 0").withColumn("step_us", F.col("ms") * 1000 / (F.col("chunks") * F.col("k")))
    chunks = r.join(about, "recording_id").select("recording_id", F.lit(STEP_FS).alias("fs"), "chunk_id", (F.col("chunk_id") * F.col("k")).cast("long").alias("sample_offset"), "samples", "arrived_at")
    return chunks, about.select("recording_id", "step_us")


def _events(s, d):
    return spikes.detect(_previews(s, d)[0], PREVIEW)


def waveform_features(s, d):
    """Detection, control points, features (in preview steps) and intervals (in real time) over the recordings' chunks."""
    chunks, steps = _previews(s, d)
    f = spikes.features(spikes.detect(chunks, PREVIEW), PREVIEW).join(steps, "recording_id")
    f = spikes.inter_event(f.withColumn("t_us", F.round(F.col("sample_idx") * F.col("step_us")).cast("long")))
    return f.select("recording_id", "sample_idx", *[F.round(c, 4).alias(c) for c in ("ramp_amp", "inflection_time", "peak_amp", "peak_width", "peak_sharpness", "isi", "isi_prev")], "n_spikes_50ms", "n_spikes_200ms")


def exp_decay_fit(s, d):
    f = spikes.features(_events(s, d), PREVIEW)
    return f.filter("exp_lambda is not null").select("recording_id", "sample_idx", F.round("exp_lambda", 4).alias("exp_lambda"), F.round("exp_const", 3).alias("exp_const"), F.round("r2_exp", 4).alias("r2_exp"))


def control_points(s, d):
    f = spikes.features(_events(s, d), PREVIEW)
    return f.filter("peak is not null").select("recording_id", "sample_idx", "ramp_start", "inflection", "rise", "peak", "decay", "exp_start", "exp_end")


def alt_python(s, d):
    """A user's Python function over every window."""
    return spikes.alt(_events(s, d), lambda w, fs: (w.mean(), w.std()), ["alt_mean", "alt_std"]).select("recording_id", "sample_idx", r6("alt_mean").alias("alt_mean"), r6("alt_std").alias("alt_std"))


def second_signal(s, d):
    """Mean and spread of a second signal around the events of the first: here the squares of the previews at a third of the rate."""
    chunks, _ = _previews(s, d)
    ev = spikes.detect(chunks, PREVIEW).withColumn("peak", F.col("sample_idx"))
    thin = F.filter(F.transform("samples", lambda v, i: F.when(i % 3 == 0, v * v)), lambda v: v.isNotNull())
    second = chunks.filter("samples is not null").select("recording_id", (F.col("fs") / 3).alias("fs"), "chunk_id", (F.col("sample_offset") / 3).cast("long").alias("sample_offset"), thin.alias("samples"), "arrived_at")
    w = spikes.other_signal(ev, second, "peak", (6.0, 6.0))
    return spikes.alt(w, lambda x, fs: (x.mean(), x.std()), ["mean", "std"], errors=True).select("recording_id", "sample_idx", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "alt_error")


def piecewise_poly(s, d):
    """Three joined polynomials per detected waveform."""

    def fit(w, fs):
        return np.concatenate(spikefit.piecewise_poly(w, [0, 3, 8, 13], [1, 3, 3]))

    names = [f"poly{i}_c{j}" for i, n in enumerate((2, 4, 4)) for j in range(n)]
    return spikes.alt(_events(s, d), fit, names).select("recording_id", "sample_idx", *[F.round(c, 5).alias(c) for c in names])


def gaussian_cycles(s, d):
    """Cycle points, shape and fit of inverted waveforms."""

    def fit(w, fs):
        x = -w
        c = gaussian.trough_cycles(x)
        if not c:
            return np.full(5, np.nan)
        g = gaussian.shape(x, c[0])
        return (g["time_decay"], g["time_rise"], g["time_decay_sym"], g["volt_trough"], gaussian.fit_cycle(x, 1)[1])

    return spikes.alt(_events(s, d), fit, ["time_decay", "time_rise", "decay_sym", "volt_trough", "r2"]).select("recording_id", "sample_idx", *[F.round(c, 4).alias(c) for c in ("time_decay", "time_rise", "decay_sym", "volt_trough", "r2")])


def _series(s, d):
    """Values of a user in order of time, as one array; users are many and their series short."""
    e = events(s, d).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("us", "event_id", "value"))).alias("a"))
    return e.select("user_id", F.lit(1.0).alias("fs"), F.transform("a", lambda v: v["value"]).alias("wf"))


def peak_nms(s, d):
    """Peaks of the value series at least five events apart, the highest first."""
    schema = "user_id long, i long, value double"

    def run(it):
        for pdf in it:
            for u, w in zip(pdf["user_id"], pdf["wf"]):
                x = np.asarray(w, float)
                p = signals.find_peaks(x, 50.0, 5)
                yield pd.DataFrame({"user_id": np.full(len(p), u, "int64"), "i": p.astype("int64"), "value": x[p]})

    return _series(s, d).select("user_id", "wf").mapInPandas(run, schema)


def _kernel(s, d, fn, names):
    out = spikes.alt(_series(s, d).filter("size(wf) >= 32"), fn, names)
    return out.select("user_id", *[r6(n).alias(n) for n in names])


def welch_psd(s, d):
    def fn(w, fs):
        f, p = signals.welch_psd(w, fs, 32)
        return f[np.argmax(p[1:]) + 1], p.sum()

    return _kernel(s, d, fn, ["peak_freq", "power"])


def multitaper_psd(s, d):
    """Strongest frequency and power of the whole series; beyond 512 events the mean over segments of 512."""

    def fn(w, fs):
        f, p = signals.multitaper_psd(w, fs, longest=512)
        return f[np.argmax(p[1:]) + 1], p.sum()

    return _kernel(s, d, fn, ["peak_freq", "power"])


def butter_filtfilt(s, d):
    def fn(w, fs):
        y = signals.filter_both_ways(signals.butter_sections(2, [0.05, 0.2], fs, "band"), w)
        return y.mean(), y.std()

    return _kernel(s, d, fn, ["mean", "std"])


def aperiodic_fit(s, d):
    def fn(w, fs):
        f, p = signals.welch_psd(w, fs, 32)
        a = signals.aperiodic_fit(f, p, 0.03, 0.5)
        return a["offset"], a["exponent"], signals.band_area(f, p, a, 0.1, 0.3), signals.band_area(f, p, a, 0.1, 0.3, clip=True)

    return _kernel(s, d, fn, ["offset", "exponent", "area", "area_clipped"])


def spectral_model(s, d):
    """Aperiodic part with a knee, number of peaks, the highest one and r2 of each user's spectrum."""

    def fn(w, fs):
        f, p = signals.welch_psd(w, fs, 32)
        g = spectra.fit(100 * f[1:], p[1:], knee=True, most=3)
        top = g["peaks"][0] if g["peaks"] else (np.nan, np.nan, np.nan)
        return g["exponent"], float(len(g["peaks"])), top[0], top[1], g["r2"]

    return _kernel(s, d, fn, ["exponent", "peaks", "centre", "height", "r2"])


def spectral_bands(s, d):
    """Mean centre and height of the peaks of each user's spectrum in each band, in fixed slots."""

    def fn(w, fs):
        f, p = signals.welch_psd(w, fs, 32)
        t = spectra.band_table(spectra.fit(100 * f[1:], p[1:], most=6)["peaks"])
        return [x for n, *_ in spectra.BANDS for x in t.get(n, (np.nan, np.nan))[:2]]

    return _kernel(s, d, fn, [f"{n}_{k}" for n, *_ in spectra.BANDS for k in ("centre", "height")])


def spectral_grid(s, d):
    """Exponents of each user's spectrum for every window length and model of a grid, fits of r2 below 0.2 left out."""
    out = None
    for length in (16, 32):
        for knee in (False, True):

            def fn(w, fs, length=length, knee=knee):
                f, p = signals.welch_psd(w, fs, length)
                g = spectra.fit(100 * f[1:], p[1:], knee=knee, most=2)
                return g["exponent"], g["r2"]

            one = _kernel(s, d, fn, ["exponent", "r2"]).filter("r2 >= 0.2").select("user_id", F.lit(length).alias("length"), F.lit("knee" if knee else "fixed").alias("mode"), "exponent", "r2")
            out = one if out is None else out.unionByName(one)
    return out


def psd_peakiness(s, d):
    def fn(w, fs):
        k = signals.peakiness(*signals.welch_psd(w, fs, 32), mains=0.3, width=0.02)
        return k["freq"], k["prominence"], k["fwhm"]

    return _kernel(s, d, fn, ["freq", "prominence", "fwhm"])


def simple_lfp(s, d):
    """Sliding windows of 32 events every 8: mean, spread and slope of the log spectrum."""
    schema = "user_id long, start long, mean double, std double, exponent double"

    def run(it):
        for pdf in it:
            for u, w in zip(pdf["user_id"], pdf["wf"]):
                x, rows = np.asarray(w, float), []
                for a in range(0, len(x) - 31, 8):
                    y = x[a : a + 32]
                    p = np.abs(np.fft.rfft(y)) ** 2 / 32
                    f = np.fft.rfftfreq(32)
                    rows.append((u, a, y.mean(), y.std(), -np.polyfit(np.log10(f[1:]), np.log10(p[1:] + 1e-12), 1)[0]))
                yield pd.DataFrame(rows, columns=["user_id", "start", "mean", "std", "exponent"])

    out = _series(s, d).select("user_id", "wf").mapInPandas(run, schema)
    return out.select("user_id", "start", *[r6(c).alias(c) for c in ("mean", "std", "exponent")])


def pelt_changepoints(s, d):
    """Mean shifts of the daily medians per user."""
    g = events(s, d).groupBy("user_id", F.floor(F.col("us") / DAY).cast("long").alias("day")).agg(F.percentile("value", 0.5).alias("b"))
    series = g.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("day", "b"))).alias("a"))
    schema = "user_id long, changepoint long"

    def run(it):
        for pdf in it:
            for u, a in zip(pdf["user_id"], pdf["a"]):
                c = signals.changepoints(np.array([v["b"] for v in a]))
                yield pd.DataFrame({"user_id": np.full(len(c), u, "int64"), "changepoint": np.array([a[i]["day"] for i in c], "int64")})

    return series.mapInPandas(run, schema)


def kmeans1d(s, d):
    """Deterministic two-means of the values of each event type: centres and cutoff."""
    schema = "event_type string, low double, high double, cutoff double"

    def run(pdf):
        got = cluster1d.kmeans(pdf["value"].to_numpy(), 2, weights=pdf["n"].to_numpy())
        row = (pdf["event_type"].iat[0], *(got[1].tolist() + [float(got[2][0])] if got else [None] * 3))
        return pd.DataFrame([row], columns=["event_type", "low", "high", "cutoff"])

    # equal values weigh by their count; what a task sees is the value histogram of one type
    e = table(s, d, "events").select("event_type", F.round("value", 2).alias("value")).filter("value is not null").groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("n"))
    return e.groupBy("event_type").applyInPandas(run, schema).select("event_type", *[r6(c).alias(c) for c in ("low", "high", "cutoff")])


def cluster_multimodal(s, d):
    """Number of modes of each waveform's samples, by the bimodality gate."""
    return waveforms(s, d).select("vec_id", registry.array_udfs()["mode_count"]("wf").alias("modes"))


def temporal_transitions(s, d):
    """Sigmoid changes of the rolling label level per user."""

    def fn(w, fs):
        y = np.convolve(np.digitize(w, (33, 66)), np.ones(10) / 10, "valid")
        g = m.sigmoids(np.arange(len(y)), y, most=2)
        return (g["k"], g["r2"], g["centres"][0]) if g else np.full(3, np.nan)

    out = _kernel(s, d, fn, ["k", "r2", "centre"])
    return out.filter("k is not null").select("user_id", "k", F.round("r2", 3).alias("r2"), F.round("centre", 2).alias("centre"))


def ridge_cv(s, d):
    """Ridge regression of the first waveform sample on eight others, per label."""
    schema = "label int, n long, r2 double, alpha double, p double"

    def run(pdf):
        x = np.stack(pdf["wf"].to_numpy()).astype(float)
        g = m.ridge_cv(x[:, 1:9], x[:, 0], permutations=50)
        return pd.DataFrame([(pdf["label"].iat[0], *((g["n"], g["r2"], g["alpha"], g["p"]) if g else [None] * 4))], columns=["label", "n", "r2", "alpha", "p"])

    w = waveforms(s, d).groupBy("label").applyInPandas(run, schema)
    q = ranks.benjamini_hochberg(w, "p")
    return q.select("label", "n", F.round("r2", 4).alias("r2"), F.round("alpha", 4).alias("alpha"), F.round("p", 4).alias("p"), F.round("q", 4).alias("q"))


def ols_hc3(s, d):
    """Least squares of price on size per brand with HC3 standard errors, from moments and one pass over the residuals."""
    p = table(s, d, "part").select("p_brand", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").cast("double").alias("y")).filter("x is not null and y is not null")
    g = p.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("vx"), F.covar_pop("x", "y").alias("c")).filter("n > 2 and vx > 0").withColumn("b1", F.col("c") / F.col("vx"))
    j = p.join(g, "p_brand").withColumn("u", F.col("x") - F.col("mx"))
    j = j.withColumn("e", F.col("y") - F.col("my") - F.col("b1") * F.col("u")).withColumn("h", 1 / F.col("n") + F.col("u") * F.col("u") / (F.col("n") * F.col("vx")))
    term = F.col("u") * F.col("e") / (F.when(F.col("h") < 1, 1 - F.col("h")) * F.col("n") * F.col("vx"))
    r = j.groupBy("p_brand").agg(F.first("b1").alias("b1"), F.first("my").alias("my"), F.first("mx").alias("mx"), F.sqrt(F.sum(term * term)).alias("se1"))
    return r.select("p_brand", F.round(F.col("my") - F.col("b1") * F.col("mx"), 4).alias("b0"), F.round("b1", 4).alias("b1"), F.round("se1", 4).alias("se1"))


def bootstrap_ci(s, d):
    """Percentile interval of the mean balance per segment: Poisson bootstrap, one pass, no resample is built."""
    b = 200
    c = table(s, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    e = c.select("c_mktsegment", "c_acctbal", "c_custkey", F.explode(F.sequence(F.lit(0), F.lit(b - 1))).alias("b"))
    # a seeded uniform per (row, replicate) from a hash, turned into a Poisson(1) weight
    u = (F.pmod(F.xxhash64("c_custkey", "b", F.lit(42)), F.lit(1 << 30)) + 0.5) / (1 << 30)
    k, cum, term = F.lit(0), 0.0, float(np.exp(-1))
    steps = []
    for i in range(1, 9):
        cum += term
        steps.append((cum, i))
        term /= i
    for cut, i in steps:
        k = F.when(u > cut, i).otherwise(k)
    w = e.withColumn("w", k).groupBy("c_mktsegment", "b").agg((F.sum(F.col("w") * F.col("c_acctbal")) / F.sum("w")).alias("m"))
    return w.groupBy("c_mktsegment").agg(F.round(F.percentile("m", 0.025), 4).alias("lo"), F.round(F.percentile("m", 0.975), 4).alias("hi"))


def entity_bootstrap(s, d):
    """Median of user medians under a bootstrap that draws users, not events."""
    med = events(s, d).groupBy("user_id").agg(F.percentile("value", 0.5).alias("m"))
    e = med.select("user_id", "m", F.explode(F.sequence(F.lit(0), F.lit(199))).alias("b"))
    u = (F.pmod(F.xxhash64("user_id", "b", F.lit(7)), F.lit(1 << 30)) + 0.5) / (1 << 30)
    k = F.when(u > 0.981, 3).when(u > 0.9197, 2).when(u > 0.7358, 1).otherwise(0) + F.when(u > 0.3679, 1).otherwise(0)
    r = e.withColumn("w", k).filter("w > 0").groupBy("b").agg(F.expr("percentile(m, 0.5, w)").alias("m"))
    return r.agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile("m", 0.025), 4).alias("lo"), F.round(F.percentile("m", 0.975), 4).alias("hi"))


def permutation_test(s, d):
    """Share of label permutations whose difference of means between two labels is at least the observed one."""
    w = waveforms(s, d).filter("label in (0, 1)").select("vec_id", "label", F.element_at("wf", 1).alias("x"))
    n1 = w.agg(F.sum((F.col("label") == 1).cast("int")).alias("n1"), F.avg(F.when(F.col("label") == 1, F.col("x"))).alias("a"), F.avg(F.when(F.col("label") == 0, F.col("x"))).alias("b"))
    e = w.select("vec_id", "x", F.explode(F.sequence(F.lit(0), F.lit(499))).alias("b"))
    rank = F.row_number().over(Window.partitionBy("b").orderBy(F.xxhash64("vec_id", "b", F.lit(3)), "vec_id"))
    p = e.withColumn("r", rank).join(F.broadcast(n1.withColumnRenamed("b", "mb")))
    g = p.groupBy("b").agg((F.avg(F.when(F.col("r") <= F.col("n1"), F.col("x"))) - F.avg(F.when(F.col("r") > F.col("n1"), F.col("x")))).alias("d"), F.first("a").alias("a"), F.first("mb").alias("mb"))
    return g.agg(r6(F.first(F.col("a") - F.col("mb"))).alias("observed"), r6(F.avg((F.abs("d") >= F.abs(F.col("a") - F.col("mb"))).cast("double"))).alias("p"))


def test_p_values(s, d):
    """p-values of statistics by UDF: Welch per day."""
    from .statistics import sliding_welch

    return sliding_welch(s, d).select("t", r6(registry.test_udfs()["p_t"]("stat", "df")).alias("p"))


def classifier(s, d):
    """Logistic regression, linear support vectors and random forest on the waveforms: accuracy on the fifth held out by hash, with its bootstrap interval."""
    from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    x = waveforms(s, d).select("vec_id", F.col("label").cast("double").alias("label"), array_to_vector("wf").alias("features"))
    held = F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(5)) == 0
    out = None
    for name, model in (("logit", LogisticRegression(maxIter=20)), ("svm", OneVsRest(classifier=LinearSVC(maxIter=10))), ("forest", RandomForestClassifier(numTrees=10, maxDepth=4, seed=42))):
        right = model.fit(x.filter(~held)).transform(x.filter(held)).select((F.col("prediction") == F.col("label")).cast("double").alias("ok"))
        acc = right.agg(F.lit(name).alias("model"), F.count("ok").alias("n"), F.round(F.avg("ok"), 2).alias("accuracy"), F.avg("ok").alias("p"))
        # resampled accuracies of n rows are binomial: the interval needs no copies of the rows
        half = 1.96 * F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n"))
        acc = acc.select("model", "n", "accuracy", F.round(F.greatest(F.col("p") - half, F.lit(0.0)), 2).alias("lo"), F.round(F.least(F.col("p") + half, F.lit(1.0)), 2).alias("hi"))
        out = acc if out is None else out.unionByName(acc)
    return out


def waveform_pca(s, d):
    """Share of variance of the first three principal components of standardised waveforms."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector

    x = waveforms(s, d).select(array_to_vector("wf").alias("v"))
    z = StandardScaler(inputCol="v", outputCol="z", withMean=True).fit(x).transform(x)
    v = PCA(k=3, inputCol="z", outputCol="p").fit(z).explainedVariance.toArray()
    return s.createDataFrame([(i + 1, round(float(a), 6)) for i, a in enumerate(v)], "component int, share double")


def _replay(s, d, columns):
    """The events table as a stream of files, in a shared scratch folder."""
    e = table(s, d, "events").select(*columns)
    src = folder(s, "stream")
    e.write.parquet(src)
    return s.readStream.schema(e.schema).parquet(src)


def _drain(s, stream, mode):
    """The stream's result as a table in the scratch folder; nothing passes through the driver."""
    out, schema = folder(s, "sink"), stream.schema
    s.createDataFrame([], schema).write.parquet(out)
    write = lambda df, _: df.write.mode("overwrite" if mode == "complete" else "append").parquet(out)
    q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", folder(s, "progress")).trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.schema(schema).parquet(out)


def streaming_tumbling(s, d):
    """Daily counts per type from a replayed stream; equal to the batch result."""
    st = _replay(s, d, [F.col("ts").cast("timestamp").alias("ts"), "event_type", "value"])
    t = _drain(s, streaming.tumbling(st, "ts", "1 day", "0 seconds", "event_type"), "complete")
    return t.select(F.unix_micros("start").alias("start_us"), "event_type", "n", r6("mean").alias("mean"))


def streaming_session(s, d):
    """Sessions of a user that end after six hours; equal to the batch islands."""
    st = _replay(s, d, [F.col("ts").cast("timestamp").alias("ts"), "user_id"])
    t = _drain(s, streaming.sessions(st, "ts", "6 hours", "0 seconds", "user_id"), "complete")
    return t.select("user_id", F.unix_micros("start").alias("start_us"), "n")


def streaming_sliding(s, d):
    """Counts and means of two days every day from a replayed stream; equal to the batch result."""
    st = _replay(s, d, [F.col("ts").cast("timestamp").alias("ts"), "event_type", "value"])
    t = _drain(s, streaming.sliding(st, "ts", "2 days", "1 day", "0 seconds", "event_type"), "complete")
    return t.select(F.unix_micros("start").alias("start_us"), "event_type", "n", r6("mean").alias("mean"))


def streaming_refractory(s, d):
    """Events at least an hour after the last kept one of their user."""
    st = _replay(s, d, ["user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")])
    return _drain(s, streaming.refractory(st, "user_id", 3_600_000_000), "append").select("user_id", "us")


NAMES = "waveform_features exp_decay_fit control_points alt_python second_signal piecewise_poly gaussian_cycles peak_nms welch_psd multitaper_psd butter_filtfilt aperiodic_fit spectral_model spectral_bands spectral_grid psd_peakiness simple_lfp pelt_changepoints kmeans1d cluster_multimodal temporal_transitions ridge_cv ols_hc3 bootstrap_ci entity_bootstrap permutation_test test_p_values classifier waveform_pca streaming_tumbling streaming_sliding streaming_session streaming_refractory"


def queries():
    return {n: globals()[n] for n in NAMES.split()}


def oracle_sql():
    return {
        "streaming_tumbling": f"select epoch_us(ts) // {DAY} * {DAY} start_us, event_type, count(*) n, round(avg(value), 6) mean from events group by 1, 2",
        "streaming_sliding": f"with w as (select epoch_us(ts) // {DAY} * {DAY} - k * {DAY} s, event_type, value from events, (values (0), (1)) t(k)) select s start_us, event_type, count(*) n, round(avg(value), 6) mean from w group by 1, 2",
        "streaming_refractory": "with recursive e as (select user_id, epoch_us(ts) us from events), r as (select user_id, min(us) us from e group by 1 union all select r.user_id, min(e.us) from r join e on e.user_id = r.user_id and e.us >= r.us + 3600000000 group by r.user_id) select user_id, us from r",
        "ols_hc3": "with p as (select p_brand, p_size::double x, p_retailprice::double y from part), g as (select p_brand, count(*) n, avg(x) mx, avg(y) my, var_pop(x) vx, covar_pop(x, y) / var_pop(x) b1 from p group by 1 having count(*) > 2 and var_pop(x) > 0), j as (select p_brand, b1, mx, my, n, vx, x - mx u, y - my - b1 * (x - mx) e, 1.0::double / n + (x - mx) ^ 2 / (n * vx) h from p join g using (p_brand)) select p_brand, round(any_value(my - b1 * mx), 4) b0, round(any_value(b1), 4) b1, round(sqrt(sum((u * e / ((1 - h) * n * vx)) ^ 2)), 4) se1 from j group by 1",
        "streaming_session": "with x as (select user_id, epoch_us(ts) us, case when lag(epoch_us(ts)) over w is null or epoch_us(ts) - lag(epoch_us(ts)) over w >= 21600000000 then 1 else 0 end f from events window w as (partition by user_id order by epoch_us(ts), event_id)), g as (select *, sum(f) over (partition by user_id order by us, f desc rows unbounded preceding) g from x) select user_id, min(us) start_us, count(*) n from g group by user_id, g",
    }
