"""The feature ablation against a plain computation of every cell."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldstone.catalog.storage import SMALL
from foldstone.operators import splits as S
from foldstone.operators import vectors as N
from foldstone.plans import ablation as P
from foldstone.sources import audio as W
from foldstone.vocab import GROUP_EPS

BASE = SMALL.replace(extras=())


@pytest.fixture(scope="module")
def files(spark):
    """Clips of six groups and three classes, which differ in pitch by a little; a silent, an empty and a bad file, one without a class."""
    draw, rows = np.random.default_rng(3), []
    for i in range(72):
        n = int(draw.integers(100, 3000))
        y = np.sin(np.arange(n) * (0.2 + 0.02 * (i // 6 % 3) + 0.1 * (i % 6))) * draw.uniform(0.01, 1) + draw.normal(0, 0.1, n)
        rows.append((i, f"g{i % 6}", "abc"[i // 6 % 3] if i != 5 else None, (np.clip(y / 2, -1, 1) * 32000).astype("<i2").tobytes()))
    rows += [(72, "g0", "a", bytes(4000)), (73, "g1", "b", b"")]
    made = spark.createDataFrame([(k, g, c, bytearray(b)) for k, g, c, b in rows], "key long, grp string, label string, raw binary")
    good = made.select("key", "grp", "label", W.pcm_blob(F.col("raw"), F.when(F.col("key") % 2 == 0, 16000).otherwise(8000), F.lit(1)).alias("content"))
    bad = spark.createDataFrame([(74, "g2", "c", bytearray(b"no file"))], "key long, grp string, label string, content binary")
    return good.unionByName(bad).repartition(5)


def plain(rows, group_normalised):
    """Accuracy and macro-F1 of (group, label, fold, vector): scaled by the train side, nearest class mean."""
    group, label, fold = (np.array([r[i] for r in rows], object) for i in range(3))
    x = np.stack([r[3] for r in rows])
    if group_normalised:
        for g in set(group):
            own = x[group == g]
            x[group == g] = (own - own.mean(0)) / (own.std(0) + GROUP_EPS)
    names = sorted(set(label), key=lambda v: (v is not None, v))
    guess = np.empty(len(x), object)
    for f in set(fold):
        train, sd = x[fold != f], x[fold != f].std(0)
        sd[sd <= 1e-12 * np.abs(train.mean(0))] = 1
        z = (x - train.mean(0)) / sd
        seen = [c for c in names if ((label == c) & (fold != f)).any()]
        d = np.stack([((z - z[(label == c) & (fold != f)].mean(0)) ** 2).sum(1) for c in seen], 1)
        guess[fold == f] = np.array(seen, object)[d.argmin(1)][fold == f]
    hit = np.array([a == b and a is not None for a, b in zip(label, guess)])
    f1 = []
    for c in set(label) | set(guess):
        own = 0 if c is None else 2 * sum((label == c) & (guess == c))
        f1.append(own / (sum(v is c or v == c for v in label) + sum(v is c or v == c for v in guess)))
    return len(x), hit.mean(), np.mean(f1)


def test_every_cell_scales_by_the_train_side(files):
    got = {r["ordinal"]: r for r in P.ablation(files, "grp", "label", BASE).collect()}
    grid = P.settings_grid(BASE)
    assert [(got[i]["axis"], got[i]["config"]) for i in range(len(grid))] == [(a, s.name) for a, s in grid]
    folds = {r["key"]: r["fold"] for r in S.with_group_fold(files.select("key", "grp"), "grp").collect()}
    about = {r["key"]: (r["grp"], r["label"], folds[r["key"]]) for r in files.select("key", "grp", "label").collect()}
    vectors = {r["key"]: r for r in W.extract_each(W.decode(files, "key"), "key", {f"f{s.hash}": s for _, s in grid}).collect()}
    differ = set()
    for i, (_, s) in enumerate(grid):
        rows = [(*about[k], np.array(r[f"f{s.hash}"])) for k, r in vectors.items() if r[f"f{s.hash}"] is not None]
        n, accuracy, macro = plain(rows, s.normalisation == "per_speaker")
        assert got[i]["n"] == n and np.allclose([got[i]["accuracy"], got[i]["macro_f1"]], [accuracy, macro]), s.name
        differ.add(round(macro, 6))
    assert len(differ) > 5 and got[0]["vs_control_pp"] == 0


def test_scaler_of_merged_parts(spark):
    """A scaler a fold from moments of parts; a constant that rounding spreads is still one."""
    draw = np.random.default_rng(1)
    x = np.c_[draw.normal(5, 2, 90), np.full(90, 0.1), np.zeros(90)]
    df = spark.createDataFrame([(i % 3, i % 7, [float(v) for v in row]) for i, row in enumerate(x)], "fold int, part int, vec array<double>")
    parts = N.moments(df, ["fold", "part"], "vec")
    got = {r["fold"]: r for r in N.fit_scaler(parts, None, "global", "fold").collect()}
    for f in range(3):
        own = x[f::3]
        assert np.allclose(got[f]["mean"], own.mean(0)) and np.allclose(got[f]["scale"], [own[:, 0].std(), 1, 1])


def test_settings_share_spectra(monkeypatch):
    """One spectrum a framing and trim, whatever the number of settings and of clips; vectors as of a single one."""
    calls, rfft = [], np.fft.rfft
    draw = np.random.default_rng(2)
    clips = [draw.normal(0, 0.1, n).astype("float32") for n in (1, 130, 300, 500, 700, 5000)] + [np.zeros(400, "float32")]
    settings = {str(i): s for i, (_, s) in enumerate(P.settings_grid(BASE))}
    each = {name: W.extractor({name: s}) for name, s in settings.items()}
    alone = {name: [one([y])[name] for y in clips] for name, one in each.items()}
    monkeypatch.setattr(np.fft, "rfft", lambda *a, **b: calls.append(1) or rfft(*a, **b))
    together = W.extractor(settings)(clips)
    assert len(calls) == len({(s.n_fft, s.hop_length, s.trim) for s in settings.values()}) == 4
    for name, (at, x) in together.items():
        assert at.tolist() == [i for i, (own, _) in enumerate(alone[name]) if len(own)]
        assert np.allclose(x, np.vstack([v for own, v in alone[name] if len(own)]))
