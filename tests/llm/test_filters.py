"""Toxicity, decontamination, secrets and PII: held-out accuracy, brute force and odd inputs."""

import re
import uuid

import numpy as np
import pytest

from docgraph.llm import decontaminate, pii, secrets, toxicity
from tests.llm.conftest import frame, prose

DIR = "/root/testdata/sf0.01"


def test_kernel_by_enumeration():
    def plain(a, b):
        def feats(u):
            c = [toxicity.BEGIN, *toxicity._CODE[np.frombuffer(u, np.uint8)].tolist(), toxicity.END]
            out = {}
            for i, j, k in toxicity._triples(len(c)):
                key = c[i], c[j], c[k]
                out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i + 1)
            return out

        x, y = feats(a), feats(b)
        dot = lambda p, q: sum(v * q.get(k, 0) for k, v in p.items())
        return dot(x, y) / np.sqrt(dot(x, x) * dot(y, y))

    words = [b"idiot", b"idxiot", b"table", b"id1ot", b"ab"]
    got = toxicity.kernel([toxicity.tensor(w) for w in words], [toxicity.tensor(w) for w in words])
    assert np.allclose(got, [[plain(a, b) for b in words] for a in words])
    assert got[0, 1] > got[0, 2]


def toxic_corpus(n=400, seed=0):
    rng = np.random.default_rng(seed)
    insults = ["blorkhead", "snarfwit", "grumbzole"]
    rows, toxic = [], []
    for i in range(n):
        words = prose(i + 5000, int(rng.integers(20, 60)), 200).split()
        bad = bool(rng.random() < 0.3)
        if bad:
            w = insults[int(rng.integers(0, 3))]
            if i > n // 2 and rng.random() < 0.5:  # inserted characters and gaps only in the held-out half
                k = int(rng.integers(2, len(w) - 1))
                w = w[:k] + str(rng.choice(list("-x.1"))) + w[k:]
            words.insert(int(rng.integers(0, len(words))), w)
        rows.append((i, " ".join(words), "s"))
        toxic.append(bad)
    return rows, np.array(toxic)


def test_toxicity_held_out(spark):
    rows, toxic = toxic_corpus()
    half = len(rows) // 2
    labels = spark.createDataFrame([(i, 1, int(toxic[i])) for i in range(half)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"] for r in toxicity.toxic_documents(frame(spark, rows), labels).collect()}
    held = [i for i in range(half, len(rows))]
    hit = sum(i in got for i in held if toxic[i]) / max(1, sum(toxic[i] for i in held))
    wrong = sum(i in got for i in held if not toxic[i]) / max(1, sum(not toxic[i] for i in held))
    assert hit >= 0.9 and wrong <= 0.03


def test_toxicity_phrases(spark):
    """An insult that is a pair of words, each of which also stands in clean sentences, is learned from labels alone."""
    rng = np.random.default_rng(3)
    rows, toxic = [], []
    for i in range(900):
        words = prose(i + 8000, int(rng.integers(8, 25)), 200).split()
        at = int(rng.integers(0, len(words)))
        bad = i % 3 == 0
        if bad:
            words[at:at] = ["dumb", "cattle"] if i % 2 else ["rotten", "goblin"]
        else:
            for w in ["dumb", "cattle"] if i % 2 else ["rotten", "goblin"]:
                words.insert(int(rng.integers(0, len(words))), w)
            text = " ".join(words)
            bad = "dumb cattle" in text or "rotten goblin" in text
        rows.append((i, " ".join(words), "s"))
        toxic.append(bad)
    labels = spark.createDataFrame([(i, 1, int(toxic[i])) for i in range(600)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"] for r in toxicity.toxic_documents(frame(spark, rows), labels).collect()}
    held = range(600, 900)
    hit = sum(i in got for i in held if toxic[i]) / sum(toxic[i] for i in held)
    wrong = sum(i in got for i in held if not toxic[i]) / sum(not toxic[i] for i in held)
    assert hit >= 0.9 and wrong <= 0.03, (hit, wrong)


@pytest.mark.parametrize("pairs", [False, True])
def test_toxicity_decision_by_explicit_sums(pairs):
    """The scorer against the kernel's feature vectors of every unit and pair of every text, one by one."""
    import pyarrow as pa

    rng = np.random.default_rng(9)
    model = toxicity.Model(rng.standard_normal((toxicity.A**3, 3)), -0.2, -0.1 if pairs else -9.0, 0.5)
    texts = ["one two three", "a b c d", "id-iot here", "x" * 50 + " tail", "größe 日本語 text", "", None, "!!", "some-long-compound-idiot again and again"]
    score, word = toxicity.Scorer(model)(pa.array(texts))

    def value(unit, k):
        out = []
        for v in toxicity.windows(unit):
            p, x = toxicity.tensor(v)
            out.append(x @ model.weights[p, k])
        return max(out) if k else max(0.0, *out)

    for t, got in zip(texts, score, strict=True):
        u = toxicity.units(pa.array([t], pa.string()))
        want = -9.0
        strings = u.bytes(np.arange(len(u.hash)))
        for unit in strings:
            want = max(want, (value(unit, 0) if len(unit) > 1 or not unit.isascii() else 0.0) + model.bias)
        if pairs:
            for i, j in zip(*u.pairs(), strict=True):
                parts = [max(0.0, value(strings[x], k)) if len(strings[x]) > 1 else 0.0 for k, x in ((1, i), (2, j))]
                want = max(want, sum(parts) / 2 + model.pair_bias)
        assert abs(got - want) < 1e-9, t
    assert word[1] >= 0 and word[5] == word[6] == word[7] == -1


def test_toxicity_training_holds_little():
    """The units of many texts are those of all texts at once, and a few times their size is held at most."""
    import tracemalloc

    import pyarrow as pa

    texts = [prose(k, 400, 300) + " i d i o t größe id-iot" for k in range(150)] + ["", "word"]
    u = toxicity.units(pa.array(texts, pa.string()))
    names, strings, of, doc, single = toxicity.units_of(texts)
    assert (names[of] == u.hash).all() and (doc == u.doc).all() and (single == u.single).all()
    assert [strings[i] for i in of[:5000]] == u.bytes(np.arange(5000))
    many = texts * 40
    size = sum(len(t) for t in many)
    tracemalloc.start()
    toxicity.units_of(many)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held < 10 * size


def test_toxicity_odd(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1)], "doc_id long, quality int, toxic int")
    odd = odd.withColumnRenamed("root", "a `quoted` name")
    kept = toxicity.drop_toxic(odd, labels)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert 1 in ids and 2 in ids and 3 in ids and 7 in ids
    assert toxicity.toxic_documents(none, labels).count() == 0
    assert toxicity.toxic_documents(odd, labels.limit(0)).count() == 0


def test_lcs_brute():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a, b = rng.integers(0, 5, rng.integers(1, 20)).tolist(), rng.integers(0, 5, rng.integers(1, 40)).tolist()
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert decontaminate.lcs(a, b) == t[-1, -1]


def test_decontamination_planted(spark):
    items = [(k, prose(9000 + k, 30 if k else 200, 900)) for k in range(10)]
    rows, leaked = [], set()
    rng = np.random.default_rng(4)
    for i in range(100):
        words = prose(i, 150, 900).split()
        if i % 4 == 0:
            item = items[i % 10][1].split()
            if i % 8 == 0:  # a paraphrase: every seventh word is another
                item = [("other" if j % 7 == 3 else w) for j, w in enumerate(item)]
            at = int(rng.integers(0, len(words)))
            words[at:at] = item
            leaked.add(i)
        rows.append((i, " ".join(words), "s"))
    benchmark = spark.createDataFrame([*items, (None, "x y z a b c"), (50, None), (51, "too short"), (0, items[0][1])], "item_id long, text string")
    found = decontaminate.contaminated(frame(spark, rows), benchmark).collect()
    assert {r["doc_id"] for r in found} == leaked
    assert all(r["item_id"] == r["doc_id"] % 10 for r in found)
    kept = decontaminate.drop_contaminated(frame(spark, rows), benchmark)
    assert {r["doc_id"] for r in kept.collect()} == set(range(100)) - leaked


def test_decontamination_odd(spark, odd, none):
    b = spark.createDataFrame([(1, prose(77, 20)), (2, "")], "item_id long, text string")
    assert decontaminate.contaminated(odd, b).count() == 0 and decontaminate.contaminated(none, b).count() == 0
    assert decontaminate.contaminated(odd, b.limit(0)).count() == 0
    kept = decontaminate.drop_contaminated(odd, b)
    assert kept.count() == odd.count() and kept.columns == odd.columns


def test_decontamination_odd_that_match(spark):
    """Repeated rows, null ids, a very long text and columns with clashing or quoted names, where an item is held."""
    item = prose(77, 40)
    rows = [(1, f"{prose(1, 50)} {item}", "s"), (1, f"{prose(1, 50)} {item}", "s"), (None, item, "s"), (2, f"{prose(3, 60_000)} {item}", "s"), (3, None, "s"), (4, "", "s"), (5, prose(9, 80), "s")]
    docs = frame(spark, rows).withColumnRenamed("root", "a `quoted` name").withColumnRenamed("h1", "item_id")
    b = spark.createDataFrame([(7, item, 1), (7, item, 2), (8, item, 3), (None, item, 4), (9, None, 5)], "item_id long, text string, doc_id int")
    out = decontaminate.contaminated(docs, b).collect()
    assert sorted((str(r["doc_id"]), r["item_id"]) for r in out) == sorted([(d, i) for d in ("1", "1", "2", "None") for i in (7, 8)])
    assert all(r["common_words"] == 40 for r in out)
    kept = decontaminate.drop_contaminated(docs, b)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {3, 4, 5}


def test_decontamination_chunks_of_items(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS", 2)
    items = [(k, prose(9100 + k, 30, 900)) for k in range(5)]
    rows = [(k, prose(k, 60, 900) + " " + t, "s") for k, t in items]
    b = spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(frame(spark, rows), b).collect()} == {(k, k) for k, _ in items}
    assert decontaminate.drop_contaminated(frame(spark, rows), b).count() == 0


def key(rng, alphabet, n):
    return "".join(rng.choice(list(alphabet), n))


def test_secrets_planted(spark):
    rng = np.random.default_rng(8)
    hexa, b64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows, bad = [], set()
    for i in range(200):
        text = f"{prose(i, 80)} {prose(i + 400, 30).upper()} {' '.join(map(str, rng.integers(0, 10**6, 20)))}"
        if i % 10 == 0:
            text += f" token={key(rng, hexa if i % 20 else b64, 40)} ok"
            bad.add(i)
        elif i % 10 == 1:
            text += " " + "ab" * 25 + " " + "0123456789" * 4 + " internationalisation_of_the_whole_thing"
        rows.append((i, text, "s"))
    found = secrets.find_secrets(frame(spark, rows)).collect()
    assert {r["doc_id"] for r in found} == bad
    out = {r["doc_id"]: r["text"] for r in secrets.redact(frame(spark, rows)).collect()}
    assert all(("[SECRET]" in t) == (i in bad) for i, t in out.items())
    for r in found:
        whole = rows[r["doc_id"]][1].encode()[r["start_byte"] : r["start_byte"] + r["n_bytes"]].decode()
        assert len(whole) == 40 and whole not in out[r["doc_id"]]


def test_secrets_prefixed(spark):
    """Hex keys that '_', '-' or '/' joins to a name or path are found and redacted."""
    rng = np.random.default_rng(18)
    prefixes = ["sk_live_", "key-", "services/hooks/", "aws_secret_key_"]
    rows, keys = [], {}
    for i in range(240):
        text = f"{prose(i, 80)} {' '.join(map(str, rng.integers(0, 10**6, 20)))}"
        if i % 5 == 0:
            keys[i] = key(rng, "0123456789abcdef", [32, 40, 64][i // 5 % 3])
            text += f" {prefixes[i // 15 % 4]}{keys[i]} ok"
        elif i % 5 == 1:
            text += " internationalisation_of_the_whole_thing some/long/path/of-many-parts/and_names"
        rows.append((i, text, "s"))
    docs = frame(spark, rows)
    found = {r["doc_id"] for r in secrets.find_secrets(docs).collect()}
    out = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert len(found & set(keys)) >= 0.95 * len(keys) and not found - set(keys)
    assert sum(k not in out[i] for i, k in keys.items()) >= 0.95 * len(keys)


def test_battery():
    rng = np.random.default_rng(1)
    p = [secrets.battery(rng.integers(0, 16, 40), 16) for _ in range(400)]
    assert np.mean(np.array(p) < 0.05) < 0.12
    assert secrets.battery(np.arange(40) % 16, 16) < 1e-3 and secrets.battery(np.zeros(40, int), 16) < 1e-3


def test_secrets_repeats_null_ids_and_long_texts(spark):
    rng = np.random.default_rng(4)
    secret, long = key(rng, "0123456789abcdef", 64), prose(3, 60_000)
    texts = [f"{prose(i, 60)} token={secret} {prose(i + 50, 20)}" for i in range(2)] + [f"{long} token={secret}"]
    rows = [(1, texts[0], "s"), (1, texts[0], "s"), (None, texts[1], "s"), (3, texts[2], "s"), (4, None, "s"), (5, "", "s")] + [(10 + i, prose(i + 100, 80), "s") for i in range(60)]
    docs = frame(spark, rows)
    found = secrets.find_secrets(docs).collect()
    assert sorted(str(r["doc_id"]) for r in found) == ["1", "1", "3", "None"]
    named = docs.withColumnRenamed("root", "a `quoted` name")
    out = secrets.redact(named)
    assert out.columns == named.columns and sum("[SECRET]" in (r["text"] or "") for r in out.collect()) == 4


def test_secrets_odd(spark, odd, none):
    assert {r["doc_id"] for r in secrets.find_secrets(odd).collect()} == set()
    assert secrets.find_secrets(none).count() == 0
    assert secrets.redact(none).count() == 0
    out = secrets.redact(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert out.where("doc_id = 1 AND text IS NULL").count() == 1


@pytest.fixture(scope="module")
def model():
    return pii.train([prose(k, 300) for k in range(30)], steps=pii.STEPS)


def test_pii_gradients():
    m = pii.new_model(3, 4)
    for a in m.arrays():
        a[...] = a
    rng = np.random.default_rng(0)
    m = pii.Model([w.astype(float) for w in m.wx], [u.astype(float) for u in m.u], m.wo.astype(float), m.bo.astype(float), m.trans.astype(float), m.start.astype(float))
    x, y = rng.integers(97, 110, (7, 3)), rng.integers(0, 3, (7, 3))
    _, grads = pii.loss_and_gradients(m, x, y)
    for p, g in zip(m.arrays(), grads, strict=True):
        for _ in range(6):
            at = tuple(int(rng.integers(0, n)) for n in p.shape)
            old, h = p[at], 1e-6
            p[at] = old + h
            up, _ = pii.loss_and_gradients(m, x, y)
            p[at] = old - h
            down, _ = pii.loss_and_gradients(m, x, y)
            p[at] = old
            assert abs((up - down) / (2 * h) - g[at]) < 1e-5


def test_pii_viterbi_brute(model):
    import itertools

    x = pii.codes(np.frombuffer(b"a@b.c 1", np.uint8)).astype(np.int64)[:, None]
    (fwd, _), (bwd, _) = pii._direction(x, model.wx[0], model.u[0]), pii._direction(x[::-1], model.wx[1], model.u[1])
    e = (np.concatenate([fwd, bwd[::-1]], axis=2) @ model.wo + model.bo)[:, 0]

    def score(path):
        return model.start[path[0]] + sum(e[t, k] for t, k in enumerate(path)) + sum(model.trans[a, b] for a, b in itertools.pairwise(path))

    best = max(itertools.product(range(pii._K), repeat=len(x)), key=score)
    assert pii.Decoder(model)(x)[:, 0].tolist() == list(best)


def test_pii_held_out(model):
    import pyarrow as pa

    gen = pii.Generator(prose(1234, 500).split(), 99)
    decoder = pii.Decoder(model)
    hit = wanted = found = right = 0
    for _ in range(60):
        x, y = gen.example(700)
        text = "".join(chr(c) if c < 128 else chr(c - 129 + 0xC0) if c > 128 else "日" for c in x)
        new = np.flatnonzero(np.diff(y, prepend=0) != 0).tolist() + [len(y)]
        want = {(a, b, int(y[a])) for a, b in zip(new, new[1:], strict=False) if y[a] and b < len(y)}
        _, s, e, k = pii.tag_texts(pa.array([text]), decoder)
        got = {(int(a), int(b), int(c)) for a, b, c in zip(s, e, k, strict=True)}
        wanted, found, hit = wanted + len(want), found + len(got), hit + len(want & got)
        right += sum(any(a < q and p < b and c == d for p, q, d in want) or b == len(y) or a == 0 for a, b, c in got)
    assert hit / wanted > 0.8 and right / found > 0.85


def test_pii_windows_agree(model):
    """A span that straddles windows is found once, whole, and a long text's findings are at their places."""
    import pyarrow as pa

    text = ""
    for k in range(40):
        text += prose(k, 30) + f" ann.{k:02d}@mail{k}.com "
    _, s, e, kind = pii.tag_texts(pa.array([text, None, ""]), pii.Decoder(model))
    found = [text[a:b] for a, b, k in zip(s, e, kind, strict=True) if pii.TAGS[k] == "EMAIL"]
    assert sum(f"ann.{k:02d}@mail{k}.com" in found for k in range(40)) >= 34


def test_pii_codes():
    text = "aé日ßÿ€ z"
    assert pii.codes(np.frombuffer(text.encode(), np.uint8)).tolist() == [pii.code_of(c) for c in text] == [97, 129 + 0xE9 - 0xC0, 128, 129 + 0xDF - 0xC0, 192, 128, 32, 122]


def test_pii_windows_against_whole_texts(spark, model):
    """Decoding by windows gives what decoding of whole texts at once gives, but for at most a character in a thousand."""
    import pyarrow as pa

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) BETWEEN 600 AND 4000").select("text").collect()
    decoder = pii.Decoder(model)
    chars = wrong = spans = 0
    for (text,) in rows:
        x = pii.codes(np.frombuffer(text.encode(), np.uint8))
        _, s, e, kind = pii.tag_texts(pa.array([text]), decoder)
        whole = decoder(x[:, None].astype(np.int64))[:, 0]
        got = whole * 0
        for a, b, k in zip(s, e, kind, strict=True):
            got[a:b] = k
        agree = whole == got
        agree |= got == 0  # spans without what their kind needs are left out of both
        chars, wrong, spans = chars + len(x), wrong + int((~agree).sum()), spans + len(s)
    assert chars > 20_000 and spans > 5 and wrong <= chars / 1000


def test_pii_odd(spark, odd, none, monkeypatch):
    monkeypatch.setattr(pii, "STEPS", 5)
    monkeypatch.setattr(pii.train, "__defaults__", (5, 0))
    assert pii.find_pii(none).count() == 0
    assert pii.find_pii(odd).columns == ["doc_id", "start_char", "end_char", "kind"]
    rows = pii.find_pii(odd).collect()
    assert all(0 <= r["start_char"] < r["end_char"] and r["kind"] in pii.TAGS for r in rows) and {r["doc_id"] for r in rows} <= {None, 4, 5, 6, 7, 8}


def test_pii_repeats_and_null_ids(spark, model, monkeypatch):
    monkeypatch.setattr(pii, "fit", lambda docs, background: model)
    text = prose(5, 40) + " write to ann.lee@mail.example.com now " + prose(6, 40)
    out = pii.find_pii(frame(spark, [(1, text, "s"), (1, text, "s"), (None, text, "s"), (2, None, "s"), (3, "", "s")])).collect()
    assert sorted(str(r["doc_id"]) for r in out) == ["1", "1", "None"]
    assert {text[r["start_char"] : r["end_char"]] for r in out} == {"ann.lee@mail.example.com"}


def every_window(texts, space, items):
    """The same as search() by comparing every window of every text with every item."""
    w = decontaminate.tk.words(texts, folded=True)
    out = []
    for d in range(len(texts)):
        low, high = w.bounds[d : d + 2].tolist()
        terms = (w.hash[low:high] % np.uint64(decontaminate.TERMS)).astype(int)
        for x in items.items:
            words, answer, best = x.words.tolist(), x.words[-decontaminate.ANSWER :].tolist(), None
            for b in range(low, high, decontaminate.STEP):
                close = False
                for width, vector, least in x.pieces:
                    v = space.basis[terms[b - low : b - low + width]].sum(axis=0)
                    close |= bool(v @ vector >= least * max(np.linalg.norm(v), 1e-9))
                text = w.hash[max(low, b - x.reach) : min(high, b + x.width + x.reach)].tolist()
                if close or decontaminate.has_run(answer, text):
                    common = decontaminate.lcs(words, text)
                    if decontaminate.accepted(words, text, common):
                        best = min(best or (0, 0), (-common, max(low, b - x.reach)))
            if best:
                out.append((d, x.id, best[1] - low, -best[0]))
    return sorted(out)


@pytest.mark.parametrize("level", [0.0, 1.0])
def test_decontamination_lists_lose_nothing(level):
    """Neither the lists of words nor the count of rarer words drops what the comparison of all windows accepts."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    vocabulary = [f"w{k}" for k in range(300)]
    zipf = 1 / np.arange(1, 301)
    draw = lambda n: " ".join(rng.choice(vocabulary, n, p=zipf / zipf.sum()))
    items = [(k, draw(int(rng.integers(5, 60)))) for k in range(19)] + [(19, "w0 w0 w1 w0 w0"), (20, draw(150))]
    texts = []
    for i in range(42):
        words = items[i % 21][1].split()
        words = [w if rng.random() > 0.1 * (i % 5) else "other" for w in words]
        texts.append(f"{draw(50)} {' '.join(words)} {draw(30)}")
    basis = rng.standard_normal((decontaminate.TERMS, decontaminate.RANK)).astype(np.float32) + np.float32(level)
    space = decontaminate.Space(basis, rng.random(decontaminate.TERMS).astype(np.float32))
    known = decontaminate.prepare_items(items, space)
    column = pa.array([*texts, None, "", "w0", texts[0]])
    got = decontaminate.search(column, space, known)
    assert got == every_window(column, space, known) and len(got) > 15


def test_decontamination_all_windows_of_a_table(spark):
    """search() against every window of every text of the smallest table, with its own benchmark and latent space."""
    import pyarrow as pa

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").where("text IS NOT NULL")
    space = decontaminate.latent_space(docs)
    rows = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()
    known = decontaminate.prepare_items([(r["item_id"], r["text"]) for r in rows][:25], space)
    texts = pa.array([t for (t,) in docs.collect() if len(t) < 3000][:80])
    assert decontaminate.search(texts, space, known) == every_window(texts, space, known)


def test_decontamination_recall_brute(spark):
    """Of all that the words around any window accept, at least nine tenths are found, in each way and length."""
    import pyarrow as pa

    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("text").where("text IS NOT NULL")
    texts = [r["text"] for r in docs.collect()]
    space = decontaminate.latent_space(docs)
    rng = np.random.default_rng(12)
    pool = [t.split() for t in texts if 100 < len(t.split()) < 300]
    words = np.concatenate(pool)
    cut = lambda n: (lambda d, a: d[a : a + n])(pool[int(rng.integers(len(pool)))], int(rng.integers(0, 30)))
    for low, high in ((15, 20), (21, 40), (41, 60)):
        items = [(k, " ".join(cut(int(rng.integers(low, high + 1))))) for k in range(60)]
        known = decontaminate.prepare_items(items, space)
        for way in ("replaced", "dropped", "spread", "answer"):
            planted = []
            for _, text in items:
                item = text.split()
                n = len(item)
                left = np.sort(rng.permutation(n)[: int(np.ceil(0.7 * n))])
                if way == "answer":
                    left = np.concatenate([np.sort(rng.permutation(n - 5)[: int(np.ceil(0.5 * n)) - 5]), np.arange(n - 5, n)])
                size = len(left) if way == "dropped" else n + n // 4 if way == "spread" else n
                passage = rng.choice(words, size).tolist()
                for a, b in zip(left if way in ("replaced", "answer") else np.sort(rng.permutation(size)[: len(left)]), left, strict=True):
                    passage[a] = item[b]
                around = pool[int(rng.integers(len(pool)))]
                at = int(rng.integers(0, len(around)))
                planted.append(" ".join([*around[:at], *passage, *around[at:]]))
            w = decontaminate.tk.words(pa.array(planted), folded=True)
            want = set()
            for k, item in enumerate(known.items):
                first, last = w.bounds[k : k + 2].tolist()
                own = item.words.tolist()
                near = (w.hash[max(first, b - item.reach) : min(last, b + item.width + item.reach)].tolist() for b in range(first, last))
                if any(decontaminate.accepted(own, x, decontaminate.lcs(own, x)) for x in near):
                    want.add((k, item.id))
            got = {(d, i) for d, i, *_ in decontaminate.search(pa.array(planted), space, known)}
            assert len(want) >= 30 and len(want & got) >= 0.9 * len(want), (low, way, len(want), len(want & got))
