import numpy as np
import pytest
from binfall.llm import chroma

RATE = 4000


def tone(pitches, rate=RATE, each=400, seed=None, noise=0.0):
    t = np.arange(each) / rate
    x = np.concatenate([np.sin(2 * np.pi * 261.6256 * 2 ** (p / 12) * t) for p in pitches])
    if noise:
        x = x + np.random.default_rng(seed).normal(size=len(x)) * noise
    return x


def pcm(x):
    return (np.clip(x, -2, 2) * 12000).astype("<i2").tobytes()


def test_frames_find_the_pitch_class():
    for p in range(12):
        f = chroma.frames(tone([p] * 20), RATE, size=1024, hop=256)
        assert (f.argmax(1) == p).all()
        assert (chroma.frames(tone([p + 12] * 20), RATE, size=1024, hop=256).argmax(1) == p).all()


def test_filters_on_the_integral_image_equal_plain_sums():
    f = np.random.default_rng(0).dirichlet(np.ones(12), 60)
    codes = chroma.fingerprint(f)
    assert len(codes) == 60 - chroma.SPAN + 1
    for at in (0, 17, len(codes) - 1):
        window = f[at : at + chroma.SPAN]
        code = 0
        for kind, c0, height, width in chroma.FILTERS:
            c1, cm, tm = min(c0 + height, 12), min(c0 + height // 2, 11), width // 2
            w = window[:width]
            if kind == 0:
                v = w[:, c0:c1].sum() / width - (c1 - c0) / 12
            elif kind == 1:
                v = (w[:, cm:c1].sum() - w[:, c0:cm].sum()) / width
            elif kind == 2:
                v = (w[tm:, c0:c1].sum() - w[:tm, c0:c1].sum()) / width
            else:
                v = (w[:tm, cm:c1].sum() + w[tm:, c0:cm].sum() - w[:tm, c0:cm].sum() - w[tm:, cm:c1].sum()) / width
            code = code << 2 | [0, 1, 3, 2][int(np.searchsorted(chroma.THRESHOLDS, v))]
        assert code == int(codes[at])


def test_alignment_equals_brute_force():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**32, 200, dtype=np.uint32)
    b = np.r_[rng.integers(0, 2**32, 15, dtype=np.uint32), a[20:180] ^ (rng.random(160) < 0.3).astype(np.uint32)]
    offset, matched, length = chroma.alignment(a, b)
    brute = {o: sum(a[i] == b[i - o] for i in range(len(a)) if 0 <= i - o < len(b)) for o in range(-len(b), len(a))}
    assert offset == max(brute, key=brute.get) == 5
    assert 160 <= matched <= 163 and length == 200
    assert chroma.alignment(b, a)[0] == -5
    assert chroma.alignment(a, rng.integers(0, 2**32, 50, dtype=np.uint32))[1] == 0


@pytest.fixture(scope="module")
def recordings():
    rng = np.random.default_rng(8)
    song = [rng.integers(0, 12, 80).tolist() for _ in range(12)]
    rows = [(i, pcm(tone(s))) for i, s in enumerate(song)]
    rows += [(20, pcm(tone(song[3]))), (21, pcm(tone(song[3], noise=0.02, seed=1))), (22, pcm(np.r_[np.zeros(896), tone(song[3])])), (23, pcm(0.4 * tone(song[3])))]
    rows += [(30, pcm(tone(song[5][:64]))), (31, pcm(tone(song[5][:30] + song[6][30:]))), (40, None), (41, b""), (42, b"\x00"), (43, pcm(np.zeros(50_000))), (44, pcm(np.zeros(50_000)))]
    return [*rows, (20, rows[3][1]), (None, rows[3][1])]


def test_components_equal_all_pairs(spark, recordings):
    df = spark.createDataFrame([(i, x, 1) for i, x in recordings], "media_id long, pcm binary, k1 int")
    got = {r.media_id: r.component_id for r in chroma.alike(df, rate=RATE).collect()}
    codes = {i: chroma.fingerprint(chroma.frames(np.frombuffer((x or b"")[: len(x or b"") // 2 * 2], "<i2") / 32768, RATE)) for i, x in recordings if i is not None}
    label = {i: i for i in codes}
    for _ in codes:
        for i in codes:
            for j in codes:
                if chroma.linked(codes[i], codes[j]):
                    label[i] = label[j] = min(label[i], label[j])
    assert {i: c for i, c in got.items() if i is not None} == label
    assert got[20] == got[21] == got[22] == got[23] == 3 and got[30] == 5 and got[31] == 31 and got[44] == 43 and got[None] is None


def test_empty_table(spark):
    assert chroma.alike(spark.createDataFrame([], "media_id long, pcm binary")).count() == 0


def brute(codes):
    """Components of all pairs: {id: least id}, from {id: codes}."""
    label = {i: i for i in codes}
    ids = sorted(codes)
    pairs = [(i, j) for n, i in enumerate(ids) for j in ids[:n] if chroma.linked(codes[i], codes[j])]
    for _ in ids:
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    return label


def test_bit_errors_few_equal_codes_and_repeated_recordings(spark, monkeypatch):
    rng = np.random.default_rng(5)
    codes = {}
    for k in range(12):
        a = rng.integers(0, 2**32, 100, dtype=np.uint32)
        codes[5 * k], codes[5 * k + 1] = a, np.where(rng.random(100) < 0.06 * k, a ^ np.uint32(1 << k), a)
        codes[5 * k + 2], codes[5 * k + 3], codes[5 * k + 4] = np.r_[a, a], rng.integers(0, 2**32, 100, dtype=np.uint32), np.r_[a[:30], rng.integers(0, 2**32, 70, dtype=np.uint32)]
        assert chroma.alignment(np.r_[a, a], a)[1] == 200
    for n in range(1, 40):  # short recordings: whole, and without their ends
        a = rng.integers(0, 2**32, n, dtype=np.uint32)
        codes[100 + 2 * n], codes[101 + 2 * n] = a, a[: max(1, -(-3 * n // 4))]
    made = spark.createDataFrame([(i, x.view(np.int32).tolist(), i) for i, x in codes.items()], "media_id long, codes array<int>, k1 long")
    monkeypatch.setattr(chroma, "fingerprints", lambda recordings: made)
    got = {r.media_id: r.component_id for r in chroma.alike(made).collect()}
    want = brute(codes)
    assert got == want and sum(want[5 * k + 1] == 5 * k for k in range(12)) >= 6 and all(want[5 * k + 2] == 5 * k and want[5 * k + 3] == 5 * k + 3 for k in range(12))
    assert [n for n in range(1, 40) if want[101 + 2 * n] != 100 + 2 * n] == []


def altered(x, kind, rng):
    """A recording again: noisy, softer, started late, cut at both ends, or all of it."""
    x = x.astype(float)
    if kind in ("noise", "all"):
        x = x + rng.normal(size=len(x)) * 300
    if kind in ("soft", "all"):
        x = x * 0.5
    if kind in ("late", "all"):
        x = np.r_[rng.normal(size=128 * 9) * 20, x]
    if kind in ("cut", "all"):
        x = x[128 * 7 : -128 * 7]
    return np.clip(x, -32768, 32767).astype("<i2").tobytes()


def test_altered_copies_are_found(spark, prose):
    """Recall of whole recordings that were recorded again: at least nine in ten, and as all pairs say."""
    rng = np.random.default_rng(2)
    kinds = ["noise", "soft", "late", "cut", "all"]
    rows = []
    for i in range(60):
        sound = chroma.render(" ".join(prose(int(rng.integers(60, 400)))))
        rows += [(2 * i, sound), (2 * i + 1, altered(np.frombuffer(sound, "<i2"), kinds[i % 5], rng))]
    got = {r.media_id: r.component_id for r in chroma.alike(spark.createDataFrame(rows, "media_id long, pcm binary"), rate=2000).collect()}
    want = brute({i: chroma.fingerprint(chroma.frames(np.frombuffer(x, "<i2"), 2000, unit=1 / 32768)) for i, x in rows})
    assert got == want
    assert sum(got[2 * i + 1] == 2 * i for i in range(60)) >= 54


def test_very_long_and_silent_recordings():
    """Counting offsets of a million equal codes takes neither a pair each nor gigabytes."""
    silent = np.zeros(1_000_000, np.uint32)
    assert chroma.linked(silent, silent[:900_000])
    assert not chroma.linked(silent, np.random.default_rng(1).integers(0, 2**32, 900_000, dtype=np.uint32))
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 3, 3000, dtype=np.uint32), rng.integers(0, 3, 2500, dtype=np.uint32)
    brute_counts = np.zeros(len(a) + len(b) + 1, np.int64)
    for i, x in zip(*chroma.landmarks(a)[:2]):
        for j, y in zip(*chroma.landmarks(b)[:2]):
            brute_counts[i - j + len(b)] += x == y
    many = chroma.MANY
    for chroma.MANY in (0, many):
        assert (chroma.offsets(a, b) == brute_counts).all()
    assert len(chroma.render("a b " * 100_000)) == 200_000 * 256
