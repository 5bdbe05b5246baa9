"""Metrics, selection, completeness, frames and waveforms against small cases and plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmill.functions import metrics
from voxmill.operators import completeness, selection, waves
from voxmill.operators import frames as fr
from voxmill.plans import jobs
from voxmill.sources import tasks as src

N = None
GROUPS = [
    ([0.1, 0.3, 0.2], [0.9, 0.5, 0.7], [0.2, 0.8, N]),
    ([0.2, 0.2], [0.6, 0.6], [N, N]),
    ([0.5, 0.1], [0.3, 0.3], [0.4, 0.4]),
    ([0.1, 0.3], [0.5, 0.9], [N, N]),
    ([0.1, 0.1], [0.5, 0.5], [0.9, 0.1]),
]
P4 = [([1, 0, 0.5], 0), ([0.5, 0.5], 0), ([0, 0.5], 1), ([0.5, 0.5], 0), ([0.4, 0.6], 1)]
P5 = [([0.9, 0.1, 0.5], 0), ([0.5, 0.5], 0), ([0, 0.5], 1), ([0.5, 0.5], 0), ([0.5, 0.5], 0)]
P6 = [([0.8, 0.2, 0.5], 0), ([N, N], 0), ([0, 1], 1), ([0.5, 0.5], 0), ([1, 0], 0), ([N, N], 0), ([N, N], 0)]
MISSING = [([N, N], [0.2, 0.2], [N, N]), ([N, N], [N, N], [N, N])]


def candidates(spark, groups):
    rows = [(g, i, f"t{i}", *v) for g, group in enumerate(groups) for i, v in enumerate(zip(*group, strict=True))]
    return spark.createDataFrame(rows, "utt long, cand_idx int, tag string, wer double, sim double, cm double").repartition(3)


def check(scored, best, expected):
    got: dict = {}
    for r in scored.collect():
        got.setdefault(r.utt, {})[r.cand_idx] = r.score
    won = {r.utt: r.cand_idx for r in best.collect()}
    for g, (scores, winner) in enumerate(expected):
        assert [got[g][i] for i in range(len(scores))] == [s if s is None else pytest.approx(s) for s in scores]
        assert won[g] == winner


def test_penalize_and_constant(spark):
    for f, expected in ((selection.score_penalize_spoof, P4), (selection.score_constant_spoof, P5)):
        scored = f(candidates(spark, GROUPS))
        check(scored, selection.pick_best(scored), expected)


def test_dynamic_weights(spark):
    scored = selection.score_dynamic_weights(candidates(spark, GROUPS + MISSING))
    check(scored, selection.pick_best_with_fallback(scored), P6)
    assert selection.losing_candidates(scored).count() == scored.count() - len(P6)


def plain_dynamic(group):
    def scaled(values):
        have = [v for v in values if v is not None]
        if not have or max(have) == min(have):
            return [None] * len(values)
        return [None if v is None else (v - min(have)) / (max(have) - min(have)) for v in values]

    w, s, c = map(scaled, group)
    out = []
    for a, b, d in zip(w, s, c, strict=True):
        terms = [(0.4, None if a is None else 1 - a), (0.4, b), (0.2, d)]
        weight = sum(x for x, t in terms if t is not None)
        out.append(sum(x * t for x, t in terms if t is not None) / weight if weight else None)
    return out


def test_dynamic_weights_on_random_groups(spark):
    rng = random.Random(5)
    pick = lambda: rng.choice([None, *[k / 10 for k in range(8)]])
    groups = [[[pick() for _ in range(k)] for _ in range(3)] for k in (rng.randint(1, 6) for _ in range(150))]
    expected = []
    for g in groups:
        scores = plain_dynamic(g)
        by = [-1 if s is None else s for s in scores] if any(s is not None for s in scores) else [-1 if s is None else s for s in g[1]]
        expected.append((scores, max(range(len(by)), key=lambda i: (round(by[i], 12), -i))))
    scored = selection.score_dynamic_weights(candidates(spark, groups))
    check(scored, selection.pick_best_with_fallback(scored), expected)


def test_shortcut_failure_and_lines(spark):
    df = candidates(spark, [([0.1], [0.2], [0.3]), ([0.1, 0.2], [0.5, 0.6], [N, N])])
    lone = {(r.utt, r.cand_idx): r.wer for r in selection.single_candidate_shortcut(df, False, False).collect()}
    assert lone == {(0, 0): None, (1, 0): 0.1, (1, 1): 0.2}
    assert selection.single_candidate_shortcut(df, True, False) is df
    best, errors = selection.first_on_scoring_failure(df.withColumn("score", F.col("sim")).withColumn("failed", F.col("wer") == 0.1))
    assert {r.utt: r.cand_idx for r in best.collect()} == {0: 0, 1: 0} and errors.count() == 2
    lines = [r.line for r in selection.score_lines(selection.score_log(df)).orderBy("utt", "cand_idx").collect()]
    assert lines[1] == "utt=1 | model=t0 | WER=0.100 | SIM=0.500 | AASIST=NA | TOTAL=0.500"
    text = src.format_score_log(selection.score_log(df).where("utt = 1").select("wer", "cm", "chosen")).collect()
    assert {tuple(r) for r in text} == {("0.100000", "", "1"), ("0.200000", "", "0")}


def test_choosing_needs_no_sort_of_its_own(spark):
    plan = selection.mark_chosen(spark.createDataFrame([(1, 0, 0.5, 0.1)], "utt long, cand_idx int, score double, sim double"))
    assert plan._jdf.queryExecution().executedPlan().toString().count("Sort [utt") == 1 and "row_number" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_one_is_chosen_among_equals(spark):
    nan = float("nan")
    rows = [(1, 0, 0.5), (1, 1, nan), (2, 0, 0.5), (2, 0, 0.5), (3, None, 0.5), (3, 0, 0.5), (4, 0, None), (4, 1, -2.0), (5, 0, 0.0), (5, 1, -0.0)]
    df = spark.createDataFrame([(*r, 0.1) for r in rows], "utt long, cand_idx int, score double, sim double")
    chosen = selection.mark_chosen(df).where("chosen").orderBy("utt").collect()
    assert [(r.utt, r.cand_idx) for r in chosen] == [(1, 1), (2, 0), (3, None), (4, 0), (5, 0)]


def test_one_exchange_serves_all_windows(spark):
    plan = selection.score_log(candidates(spark, GROUPS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_plan_candidates(spark):
    tasks = spark.createDataFrame([(7,), (8,)], "utt long")
    plan = selection.plan_candidates(spark, tasks, [("a", 2), ("b", 1)])
    assert sorted((r.utt, r.cand_idx, r.tag) for r in plan.collect()) == [(u, i, t) for u in (7, 8) for i, t in enumerate(("a_0", "a_1", "b_0"))]
    assert selection.plan_candidates(spark, tasks, []).count() == 0


def test_error_rates(spark):
    rows = [("我爱你", "我 恨 你", 1 / 3), ("", "", 0.0), ("", "a", 1.0), ("ab", "abcdef", 2.0)]
    df = spark.createDataFrame([r[:2] for r in rows], "r string, h string")
    assert [x[0] for x in df.select(metrics.cer(F.col("r"), F.col("h"))).collect()] == pytest.approx([r[2] for r in rows])
    words = spark.createDataFrame([("a b c", "a x c d"), ("a", ""), ("", "a"), (None, "a")], "r string, h string")
    assert [x[0] for x in words.select(metrics.wer("r", "h")).collect()] == [pytest.approx(2 / 3), 1.0, None, None]
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 8))] for _ in range(2))
        table = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                table[i, j] = min(table[i - 1, j] + 1, table[i, j - 1] + 1, table[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        assert metrics.edits(a, b) == table[len(a), len(b)]


def test_policies(spark):
    df = spark.createDataFrame([(0.3, "x", "ok"), (0.3, "x", "off"), (0.3, " ", "ok"), (0.3, "x", "failed"), (None, "x", "ok")], "r double, h string, s string")
    got = df.select(metrics.asr_error(F.col("r"), F.col("h"), F.col("s")), metrics.asr_error_nullable(F.col("r"), F.col("h"), F.col("s"))).collect()
    assert [tuple(r) for r in got] == [(0.3, 0.3), (0.5, None), (1.0, None), (0.5, None), (0.5, None)]


def test_probabilities_and_replies(spark):
    p = metrics.spoof_probability
    df = spark.createDataFrame([([2.0, 0.0], [0.5])], "a array<double>, b array<double>")
    row = df.select(p(F.col("a")), p(F.col("a"), "first"), p(F.col("b")), p(F.col("b"), "first"), metrics.bonafide_probability(F.slice("a", 1, 0))).first()
    assert [x if x is None else round(x, 6) for x in row] == [0.119203, 0.880797, 0.622459, 0.377541, None]
    replies = ['log\n{"cm_score": 0.25, "backend": "repo"}\n', 'x {"a":1,"cm_score": 1.5e-3} y\nbye', "boom", None]
    got = spark.createDataFrame([(r,) for r in replies], "s string").select(metrics.score_reply_or_neutral(F.col("s")).alias("r")).select("r.*").collect()
    assert [(r.score, r.backend, r.error) for r in got] == [(0.25, "repo", None), (0.0015, "regex", None), (0.5, "fallback", "boom"), (0.5, "fallback", "")]


def test_similarity(spark):
    cands = spark.createDataFrame([(1, [3.0, 4.0]), (2, [1.0, 0.0]), (3, None)], "utt long, vector array<double>")
    refs = spark.createDataFrame([(1, [3.0, 4.0]), (3, [1.0, 0.0])], "utt long, ref_vector array<double>")
    assert {r.utt: round(r.sim, 6) for r in selection.speaker_similarity(cands, refs).collect()} == {1: 1.0, 2: 0.0, 3: 0.0}


def test_completeness(spark):
    names = [("12.wav", 4096, 1.0), ("12.WAV", 5000, 1.0), ("012.wav", 4096, None), ("_tmp_12_idx_0.wav", 9999, 1.0), ("a12.wav", 9999, 1.0), ("12.wav.bak", 9999, 1.0), ("13.wav", 4095, 1.0), ("14.wav", 9999, 0.09)]
    listing = spark.createDataFrame([(f"/o/{n}", n, s, d) for n, s, d in names], "path string, name string, size long, duration_s double")
    assert [(r.utt, r.path) for r in completeness.official_outputs(listing).collect()] == [(12, "/o/012.wav")]
    done = spark.createDataFrame([(1,), (3,), (9,), (1,)], "utt long")
    assert sorted(r.utt for r in completeness.missing_ids(spark, 5, done).collect()) == [2, 4, 5]
    assert tuple(completeness.progress(done, 5).first()) == (3, 2) and tuple(completeness.progress(done, 2).first()) == (3, 0)
    sizes = spark.createDataFrame([(2, 2048), (3, 2049)], "utt long, size long")
    tasks = spark.createDataFrame([(1,), (2,), (3,)], "utt long")
    assert sorted(r.utt for r in completeness.needs_fill(tasks, sizes).collect()) == [1, 2]


def test_final_table_has_one_row_a_task(spark):
    tasks = spark.createDataFrame([(1,), (2,), (3,)], "utt long")
    chosen = spark.createDataFrame([(1, "b"), (1, "a"), (9, "z")], "utt long, wav_path string")
    fills = spark.createDataFrame([(1, "x"), (2, "y")], "utt long, wav_path string")
    assert sorted(map(tuple, completeness.final_table(tasks, chosen, fills).collect())) == [(1, "a", "chosen"), (2, "y", "fill"), (3, None, None)]


def test_routes(spark):
    rows = [(True, True), (True, False), (False, True), (False, False)]
    got = spark.createDataFrame(rows, "has boolean, piper boolean").select(completeness.sweep_route(F.col("has"), F.col("piper"))).collect()
    assert [r[0] for r in got] == ["piper", "collage", "piper", "tone"]


def flags(spark, values, clip=1):
    return spark.createDataFrame([(clip, i, float(v), bool(v)) for i, v in enumerate(values)], "clip_id long, frame_idx int, energy double, is_speech boolean")


def test_runs_merge_and_pick(spark):
    assert sorted((r.start, r.end) for r in fr.speech_runs(flags(spark, [1, 1, 0, 1]), 320).collect()) == [(0, 640), (960, 1280)]
    segs = spark.createDataFrame([(1, 0, 320), (1, 6400, 6720), (1, 30000, 30320)], "clip_id long, start long, end long")
    merged = fr.pad_and_merge(segs, 3200, 40000)
    assert sorted((r.start, r.end) for r in merged.collect()) == [(0, 9920), (26800, 33520)]
    scored = spark.createDataFrame([(1, 0, 9920, 0.2), (1, 26800, 33520, 0.5)], "clip_id long, start long, end long, score double")
    clips = spark.createDataFrame([(1, 40000), (2, 900)], "clip_id long, length long")
    got = sorted((r.clip_id, r["rank"], r.start, r.end) for r in fr.pick_top_segments(scored, 16000, clips).collect())
    assert got == [(1, 1, 26800, 33520), (1, 2, 0, 9280), (2, 1, 0, 900)]
    parts = sorted((r.part, r.kind, r.start, r.end) for r in fr.stitch_in_order(segs, 1500).collect())
    assert parts == [(1, "segment", 0, 320), (2, "segment", 6400, 6720), (3, "segment", 30000, 30320), (4, "repeat", 30000, 30320), (5, "pad", 0, 220)]


def test_policies_hum_and_floor(spark):
    df = spark.createDataFrame([(20.0, 20.0), (15.0, 14.0), (14.9, 20.0), (8.0, 20.0), (7.9, 20.0)], "snr double, hnr double")
    got = df.select(fr.denoise_policy_dual(F.col("snr")), fr.denoise_policy_auto(F.col("snr"), F.col("hnr"))).collect()
    assert [tuple(r) for r in got] == [(None, None), (None, 0.12), (0.4, None), (0.4, 0.12), (0.2, 0.12)]
    hums = [(0.2, 0.1, 50), (0.1, 0.2, 60), (0.1, 0.1, 50), (0.0005, 0.0009, None)]
    bins = spark.createDataFrame([(i, 0, f, m) for i, (a, b, _) in enumerate(hums) for f, m in ((50.0, a), (60.0, b))], "clip_id long, frame_idx int, freq_hz double, mag double")
    assert {r.clip_id: r.hum_hz for r in fr.hum_decision(bins).collect()} == {i: h for i, (_, _, h) in enumerate(hums)}
    one = spark.createDataFrame([(1, i, 50.0, float(m)) for i, m in enumerate((1, 2, 4, 9))], "clip_id long, frame_idx int, freq_hz double, mag double")
    assert [round(r.floored, 2) for r in fr.spectral_floor(one).orderBy("frame_idx").collect()] == [0, 0.83, 2.83, 7.83]


def test_range_join_is_no_nested_loop(spark):
    frames, segs = flags(spark, [1, 0, 1]), spark.createDataFrame([(1, 0, 100)], "clip_id long, start long, end long")
    plan = fr.segment_energy(frames, segs, 10)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_segments_of_a_long_clip(spark):
    """One clip of 100,000 frames with 5,000 segments: energies and the ratio against numpy, without a join."""
    n, hop = 100_000, 10
    rng = np.random.default_rng(2)
    energy = rng.random(n)
    starts = np.arange(5000) * 20 * hop + rng.integers(0, 60, 5000)
    ends = starts + rng.integers(1, 130, 5000)
    df = spark.range(n).select(F.lit(1).cast("long").alias("clip_id"), F.col("id").cast("int").alias("frame_idx"))
    df = df.join(spark.createDataFrame([(int(i), float(e)) for i, e in enumerate(energy)], "frame_idx int, energy double"), "frame_idx")
    segs = spark.createDataFrame([(1, int(a), int(b)) for a, b in zip(starts, ends, strict=True)], "clip_id long, start long, end long")
    at = np.arange(n) * hop
    owner = np.searchsorted(starts, at, "right") - 1
    held = (owner >= 0) & (at < ends[np.maximum(owner, 0)])
    sums, counts = np.bincount(owner[held], energy[held], 5000), np.bincount(owner[held], minlength=5000)
    found = fr.segment_energy(df, segs, hop)
    assert {r.start: round(r.energy, 9) for r in found.collect()} == {int(starts[k]): round(sums[k] / counts[k], 9) for k in np.flatnonzero(counts)}
    snr = fr.snr_from_speech(df, segs, hop, 100).first().snr_db
    assert abs(snr - 10 * np.log10(energy[held].mean() / energy[~held].mean())) < 1e-6


def test_frames_match_a_loop(spark):
    rng = np.random.default_rng(1)
    for size, frame, hop in ((100, 20, 10), (5, 20, 10), (41, 20, 7), (1, 1, 1)):
        y = rng.standard_normal(size)
        plain = [np.sqrt(np.mean(y[i : i + frame] ** 2) + 1e-9) for i in range(0, max(1, size - frame), hop)]
        assert fr.frame_rms(y, frame, hop) == pytest.approx(plain)


def test_joins_match_timeline_lengths():
    rng = np.random.default_rng(2)
    for power in (True, False):
        for _ in range(50):
            pieces = [rng.uniform(-1, 1, rng.integers(0, 30)) for _ in range(rng.integers(1, 6))]
            total = 0
            for k, p in enumerate(pieces):
                n = 0 if not k else min(10, total, len(p)) if power else 10 * (total > 10 < len(p))
                total += len(p) - n
            assert len(waves.overlapped(pieces, 10, power)) == total
    flat = waves.overlapped([np.full(20, 0.5), np.full(20, 0.5)], 10, False)
    assert flat == pytest.approx(np.full(30, 0.5))


def test_waves(spark):
    df = spark.createDataFrame([(1, 16000, [0.5, -0.5] * 8), (2, 16000, []), (3, 16000, None)], "clip_id long, sr int, samples array<float>")
    y, sr = F.col("samples"), F.col("sr")
    row = df.select(waves.rms_gain(y), waves.rms_normalize(y), waves.peak_limit(y), waves.to_mono(y, F.lit(2)), waves.fade(y, sr, 0.25, "half"), waves.dither(y, F.lit(4)), waves.dither(y, F.lit(4))).collect()
    level = 10 ** (-23 / 20)
    assert np.sqrt(np.mean(np.square(row[0][0]))) == pytest.approx(level, rel=1e-3)
    assert np.abs(row[0][1]).max() == pytest.approx(level, rel=1e-3)
    assert np.abs(row[0][2]).max() == pytest.approx(0.5)
    assert list(row[0][3]) == [0.0] * 8 and row[0][4][0] == 0 and row[0][5] == row[0][6]
    assert list(row[1][0]) == [] and row[2][0] is None
    head = spark.range(1).select(waves.head_cut_by_chars(F.lit(16000), F.lit(8)), F.size(waves.tone(F.lit(0.5), 1000))).first()
    assert tuple(head) == (16320, 500)
    assert waves.best_alignment(np.array([1.0, -1, 2, 0]), np.array([0.0, 0, 0, 1, -1, 2, 0, 0]), 10, 40, 100, 200) == 68
    assert waves.best_alignment(np.array([1.0, -1]), np.array([0.0, 0]), 10, 40, 100, 200) is None


def test_sources(spark, tmp_path):
    import wave

    (tmp_path / "tasks.csv").write_bytes('utt,reference_speech,text\r\n2,b.wav,"x, y"\r\n1,a.wav,你好'.encode())
    tasks = src.read_tasks(spark, str(tmp_path / "tasks.csv"))
    assert sorted(map(tuple, tasks.collect())) == [(1, "a.wav", "你好"), (2, "b.wav", "x, y")]
    assert [r.utt for r in src.limit_tasks(tasks, 1).collect()] == [1] and src.limit_tasks(tasks, 0) is tasks
    out = src.write_manifest(src.result_manifest(tasks), str(tmp_path / "run"))
    assert out.endswith("run-result") and spark.read.csv(out, header=True).count() == 2
    with wave.open(str(tmp_path / "7.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(np.array([0, 16384, -32768], "<i2").tobytes())
    clip = src.load_clips(spark, str(tmp_path / "*.wav")).first()
    assert (clip.clip_id, clip.sr, list(clip.samples)) == ("7", 8000, [0.0, 0.5, -1.0])
    assert [(r.name, r["size"]) for r in src.list_outputs(spark, str(tmp_path / "*.wav")).collect()] == [("7.wav", 50)]
    log = selection.score_log(candidates(spark, GROUPS)).withColumnRenamed("score", "final_score")
    src.write_score_log(log, str(tmp_path / "log"))
    assert spark.read.csv(str(tmp_path / "log"), header=True).count() == 11


def test_clean_clips_on_an_empty_table(spark):
    assert jobs.clean_clips(flags(spark, [1]).limit(0).select("clip_id", "frame_idx", "energy")).count() == 0


def test_error_rates_of_whole_texts(spark, tmp_path):
    """Characters and words outside ASCII count, against a plain edit distance."""
    from voxmill.queries import QUERIES

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            left, row = row, [i]
            for j, y in enumerate(b):
                row.append(min(row[-1] + 1, left[j + 1] + 1, left[j] + (x != y)))
        return row[-1]

    turns = {1: ["今天 天气很好", "今天天气 不好", "明天", ""], 2: ["Größe über alles", "Grösse uber alles", "Größe über"], 3: ["a 🙂 b", "a 🙃 b"], 4: ["plain text", "plain test"]}
    rows = [(c, t, text) for c, texts in turns.items() for t, text in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    run = lambda name: {(r.conv_id, r.turn): r for r in QUERIES[name](spark, str(tmp_path)).collect()}
    chars, words, policy = run("cer_whole"), run("wer"), run("asr_policy_whole")
    bare = lambda s: "".join(s.split())
    assert len(chars) == len(words) == len(policy) == 7
    for c, t, text in rows:
        if t:
            ref, status = turns[c][0], {0: "off", 1: "failed"}.get(t % 5, "ok")
            cer = edits(bare(ref), bare(text)) / len(bare(ref))
            assert chars[c, t].cer == pytest.approx(cer, abs=1e-6)
            assert words[c, t].wer == pytest.approx(edits(ref.split(), text.split()) / len(ref.split()), abs=1e-6)
            assert policy[c, t].neutral == pytest.approx(0.5 if status != "ok" else cer if text else 1, abs=1e-6)
            assert policy[c, t].nullable == (pytest.approx(cer, abs=1e-6) if status == "ok" and text else None)


def test_clips_of_a_hot_user_stay_bounded(spark, tmp_path, monkeypatch):
    """No row grows with a user or with the number of users, and the parts hold every sample."""
    from voxmill import queries

    sizes = {u: 5 + u % 7 for u in range(35)} | {7: 331, 9: 202}
    rows = [(1000 * u + k, u, k, "view", float((u * 31 + k * 17) % 23)) for u, n in sizes.items() for k in range(n)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts long, event_type string, value double")
    df.write.parquet(f"{tmp_path}/events.parquet")
    run = lambda name: queries.QUERIES[name](spark, str(tmp_path)).collect()
    plain = lambda name: sorted(tuple(r) for r in run(name))
    whole = {name: plain(name) for name in ("frames_rms", "wave_cuts")}
    assert len(whole["frames_rms"]) == sum(max(1, n - 2) for n in sizes.values())
    monkeypatch.setattr(queries, "CLIP", 100)
    assert {name: plain(name) for name in whole} == whole
    joined = run("wave_joins")
    assert len(joined) == 4 + 3 and max(r.linear_n for r in joined) <= 10 * 100
    levels = run("wave_levels")
    assert max(r.norm_n for r in levels) == 100 and sum(r.norm_n for r in levels) == len(rows)


def test_short_clips_have_an_alignment_row(spark, tmp_path):
    from voxmill import queries

    rows = [(100 * u + k, u, k, "view", float(k % 7)) for u, n in {1: 3, 2: 12, 3: 30, 4: 31, 5: 80}.items() for k in range(n)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.clip_id: r for r in queries.QUERIES["wave_alignment"](spark, str(tmp_path)).collect()}
    assert {k: r.n for k, r in got.items()} == {1: 3, 2: 12, 3: 30, 4: 31, 5: 80}
    assert got[1].cut is None and got[2].cut is None and got[5].cut is not None


def test_bonafide_of_logits_is_registered():
    from voxmill import queries

    assert "bonafide_prob" in queries.ORACLE_SQL
