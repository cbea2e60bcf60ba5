"""The operators through Spark, against brute force on small tables, with awkward rows."""

import collections
import hashlib
import math
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, batch string, band string"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
SHARED = " ".join(f"shared{i}" for i in range(60))
BASE = " ".join(f"base{i}" for i in range(100))
NEAR = BASE.replace("base50 ", "other ")
ROWS = [
    (1, "the cat sat on the mat " * 8), (2, "The  CAT sat\ton the mat " * 3), (3, None), (4, ""), (5, "   "), (6, LONG), (7, LONG), (8, "start here " + SHARED + " end one"), (9, SHARED + " and more of it"),
    (10, BASE), (11, NEAR), (12, BASE), (13, "é ﬁ ﬃ Ａ"), (14, "é fi ffi a"), (15, "a " * 90), (16, "a b " * 60), (17, "one two"), (18, "one two"), (19, "line\n" * 40), (20, "ends. <|endoftext|> !!"), (None, "no id at all"), (21, "x"), (21, "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), "clash", "clash") for i, t in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# ---- 1 --------------------------------------------------------------------------------------------------------------


def brute_substrings(rows, size=20):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for p in range(len(w) - size + 1):
            k = tuple(w[p : p + size])
            if k in seen:
                gone[p : p + size] = [True] * size
            seen.add(k)
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("which", ["docs", "corpus"])
def test_substrings(request, which):
    from llm.substrings import report

    df = request.getfixturevalue(which)
    df = df[0] if which == "corpus" else df
    assert sorted((tuple(r) for r in report(df).collect()), key=str) == brute_substrings(texts_of(df))


def test_substrings_take_effect(docs, empty):
    from llm.substrings import deduplicated, report

    out = deduplicated(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS)
    kept = {r.doc_id: r for r in out.collect()}
    assert kept[9].text == "and more of it" and kept[9].n_chars == 14 and kept[8].text == ROWS[7][1] and kept[2].text == ROWS[1][1]
    assert report(empty).collect() == [] and deduplicated(empty).collect() == []


def test_substrings_of_repeated_ids(again):
    """What is kept of rows that share ids doesn't hang on their order: of each distinct window one place stays, at the least id that has it."""
    from llm.substrings import deduplicated, report

    found = deduplicated(again).collect()
    assert len(found) == len(AGAIN) and all(tuple(r)[2:-1] == tuple(range(len(CLASH))) for r in found)
    for i, t in AGAIN:
        if len((t or "").split()) < 20:
            assert any(r.doc_id == i and r.text == t for r in found)
    of = lambda i: sorted(r.text or "" for r in found if r.doc_id == i)
    assert of(1) == [SHARED] and of(5) == ["aa", "zz short text"] and "beta" in of(2) and not any("shared" in t for t in of(2))
    assert all(r.n_chars == len(r.text or "") for r in found)
    removed = collections.Counter((r.doc_id, r.n_words, r.n_removed) for r in report(again).collect())
    assert removed[5, 61, 60] == 1 and removed[5, 3, 0] == 1 and sum(removed.values()) == len(AGAIN)


def test_long_repeats_are_verified_by_symbols(spark):
    """Shared symbols of high levels cover most of a long repeat, and cover nothing that isn't one."""
    from llm.substrings import _numbered, shared_symbols

    body = [f"b{i * 7919 % 5003}" for i in range(4000)]
    rows = [(1, " ".join(body)), (2, "x y z " + " ".join(body[500:3500]) + " end"), (3, " ".join(body[::-1])), (4, " ".join(body[100:180]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    covered = collections.defaultdict(set)
    for r in shared_symbols(_numbered(df)).collect():
        covered[r.doc].update(range(r.lo, r.hi + 1))
    words = {i: t.split() for i, t in rows}
    first = {}
    for i, w in words.items():
        for p in range(len(w) - 19):
            first.setdefault(tuple(w[p : p + 20]), (i, p))
    for i, places in covered.items():
        assert all(first[tuple(words[i][p : p + 20])] < (i, p) for p in places)
    assert set(covered) <= {2, 4} and len(covered[2]) > 0.5 * 2981


# ---- 2 --------------------------------------------------------------------------------------------------------------


def good_turing(counts, most=5):
    """Discounts of counts 1..most by the book, apart from the library's: Katz's formula where all counts of counts are there and it gives shares, else for fewer, else absolute discounts."""
    n = collections.Counter(counts)
    for k in range(most, 0, -1):
        if any(n[r] == 0 for r in range(1, k + 2)):
            continue
        cut = (k + 1) * n[k + 1] / n[1]
        if cut >= 1:
            continue
        d = {r: ((r + 1) * n[r + 1] / (n[r] * r) - cut) / (1 - cut) for r in range(1, k + 1)}
        if all(0 < x < 1 for x in d.values()):
            return lambda r: d.get(r, 1.0)
    off = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    return lambda r: (r - off) / r if r <= most else 1.0


def brute_katz(rows, order=3):
    """The model counted and evaluated one probability after the other, from nothing but the texts."""
    split = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")).encode().split() + ["</s>"]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    counts = [None, *(collections.Counter() for _ in range(order))]
    for i, t in rows:
        if not held(i):
            tokens = ["<s>"] * (order - 1) + split(t)
            for p in range(order - 1, len(tokens)):
                for k in range(1, order + 1):
                    counts[k][tuple(tokens[p - k + 1 : p + 1])] += 1
    n = sum(counts[1].values())
    d = [None, *(good_turing(c.values()) for c in counts[1:])]
    after = collections.defaultdict(dict)
    for k in range(2, order + 1):
        for g, c in counts[k].items():
            after[g[:-1]][g[-1]] = c
    left1 = sum((1 - d[1](c)) * c for c in counts[1].values())
    total1, left1 = (n, left1 / n) if n and left1 > 0 else (n + 1, 1 / (n + 1))
    memo = {}

    def p(h, w):
        if not h:
            c = counts[1][(w,)]
            return d[1](c) * c / total1 if c else left1
        if h not in after:
            return p(h[1:], w)
        if h not in memo:
            seen, disc = after[h], d[len(h) + 1]
            c = sum(seen.values())
            left = sum((1 - disc(v)) * v for v in seen.values())
            total, left = (c, left / c) if left > 1e-12 * c else (c + 1, 1 / (c + 1))
            memo[h] = total, left / (1 - sum(p(h[1:], x) for x in seen)), seen
        total, alpha, seen = memo[h]
        return d[len(h) + 1](seen[w]) * seen[w] / total if w in seen else alpha * p(h[1:], w)

    out = {}
    for i, t in rows:
        tokens = split(t)
        whole = ["<s>"] * (order - 1) + tokens
        base = sum(math.log10((counts[1][(w,)] + 0.1) / (n + 0.1 * (len(counts[1]) + 1))) for w in tokens)
        out[i] = (held(i), len(tokens), sum((w,) in counts[1] for w in tokens), n, base, sum(math.log10(p(tuple(whole[q : q + order - 1]), whole[q + order - 1])) for q in range(len(tokens))))
    words = [w for (w,) in counts[1]] + ["never seen"]
    if n:
        for h in [(), *sorted(after, key=str)[:30]]:  # each history's probabilities sum to one
            assert abs(sum(p(h, w) for w in words) - 1) < 1e-9
    return out


@pytest.mark.parametrize("order,hot", [(3, 1 << 21), (3, 4), (2, 1 << 21)])
def test_katz(spark, docs, order, hot):
    from llm.katz import score_documents

    rows = [r for r in texts_of(docs) if r[0] not in (6, 7)] if order == 3 else texts_of(docs)
    df = docs.where("doc_id not in (6, 7) or doc_id is null") if order == 3 else docs
    expected = brute_katz(rows, order)
    found = score_documents(df, order=order, bucket=500, hot=hot).collect()
    assert len(found) == len(rows)
    for r in found:
        e = expected[r.doc_id]
        assert tuple(r[1:5]) == e[:4]
        assert r.base_score == pytest.approx(e[4], abs=1e-6) and r.score == pytest.approx(e[5], abs=1e-6)


def test_katz_words_alone(spark, docs, monkeypatch):
    """The columns that words tell are those of the whole model, and need no n-grams."""
    from llm import katz, queries

    whole = {r.doc_id: tuple(r)[1:6] for r in katz.score_documents(docs, bucket=500).collect()}
    monkeypatch.setattr(katz, "gram_answers", None)
    found = katz.word_counts(docs, bucket=500).collect()
    assert len(found) == docs.count() and {r.doc_id: tuple(r)[1:] for r in found} == whole
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    assert queries.exact_katz_counts(spark, "").count() == len(found)
    assert katz.word_counts(docs.limit(0)).collect() == []


def test_katz_shuffles_no_batches(spark, docs):
    """Batches and the answers that are needed again are read where they are; of the last round only answers are shuffled."""
    from llm.katz import score_documents

    def nodes(plan):
        yield plan
        inner = [plan.initialPlan()] if plan.nodeName() == "AdaptiveSparkPlan" else [plan.children().apply(i) for i in range(plan.children().size())]
        for x in inner:
            yield from nodes(x)

    found = score_documents(docs, bucket=500)
    plan = list(nodes(found._jdf.queryExecution().executedPlan()))
    shuffled = [x.output().mkString(" ") for x in plan if x.nodeName() == "Exchange"]
    assert shuffled and not any("tokens" in x or "grams2" in x for x in shuffled)
    assert sum("SelectedBucketsCount" in x.simpleString(1000) or "Bucketed: true" in x.simpleString(1000) for x in plan) == 2
    assert found.count() == docs.count()


def test_katz_on_held_out_text(corpus, empty):
    """The whole table against brute force; held-out texts are likelier than by single words, and likelier with longer histories."""
    from llm.katz import score_documents

    rows = score_documents(corpus[0]).collect()
    expected = brute_katz(texts_of(corpus[0]))
    assert len(rows) == len(expected) and all(r.score == pytest.approx(expected[r.doc_id][5], rel=1e-9) for r in rows)
    held = [r for r in rows if r.held_out]
    two = {r.doc_id: r.score for r in score_documents(corpus[0], order=2).collect()}
    assert sum(r.score for r in held) > sum(two[r.doc_id] for r in held) > sum(r.base_score for r in held)
    assert score_documents(empty).collect() == []


# ---- 3 --------------------------------------------------------------------------------------------------------------


def test_mixing_meets_targets(corpus):
    from llm import mixing

    docs, labels = corpus
    rows = mixing.rates(docs, mixing.labelled_domains(labels)).collect()
    total = sum(r.n_tokens for r in rows)
    for domain, share in mixing.TARGETS.items():
        assert sum(r.n_tokens * r.rate * r["p_" + domain] for r in rows) / total == pytest.approx(share, abs=0.002)
    assert min(r.rate for r in rows) >= 0 and all(abs(r.copies - r.rate) < 1 for r in rows)
    assert all(abs(r.p_clean + r.p_low + r.p_toxic - 1) < 1e-9 for r in rows)


def test_posteriors_and_copies(corpus):
    """The whole query against naive Bayes counted one by one, and totals against their targets."""
    from llm import mixing as m

    docs, labels = corpus
    domains = sorted(m.TARGETS)
    known = {r.doc_id: r.domain for r in m.labelled_domains(labels).collect()}
    stats = m.statistics(m.telling_words(docs, m.labelled_domains(labels), domains), docs).collect()
    names = [f"f{i}" for i in range(7)]
    of = {r.doc_id: tuple(r[n] for n in names) for r in stats}
    counts = {d: sum(known.get(i) == d for i in of) for d in domains}

    def posterior(f):
        logs = []
        for d in domains:
            s = math.log((counts[d] + 0.5) / (sum(counts.values()) + 1.5))
            for k, bins in enumerate((4, 4, 4, 5, 4, 4, 4)):
                s += math.log((sum(of[i][k] == f[k] for i in of if known.get(i) == d) + 0.5) / (counts[d] + 0.5 * bins))
            logs.append(s)
        e = [math.exp(s - max(logs)) for s in logs]
        return [v / sum(e) for v in e]

    rows = m.rates(docs, m.labelled_domains(labels)).collect()
    assert len(rows) == len(of)
    for r in rows[::7]:
        assert [r["p_" + d] for d in domains] == pytest.approx(posterior(of[r.doc_id]), abs=1e-9)
    for r in rows:
        words = [w for w in "".join(c if c.isalpha() else " " for c in (dict(texts_of(docs.where(f"doc_id = {r.doc_id}")))[r.doc_id] or "")).split()] if r.doc_id % 97 == 0 else None
        assert words is None or r.n_tokens == len(words)


def test_projected_gradient_is_the_minimum(spark):
    """Rates against a plain minimisation of the same objective."""
    from llm import mixing

    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.4, 0.4, 0.4], 40)
    n = rng.integers(1, 200, 40)
    target = np.array([0.6, 0.3, 0.1])
    cells = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(n, p)], "n long, p0 double, p1 double, p2 double")
    g = mixing.fit_rates(cells, target.tolist(), steps=400)
    got = np.array([r[0] for r in cells.select(mixing.rate(g, 3)).collect()])
    share = n / n.sum()

    def cost(r):
        return (((share * r) @ p - target) ** 2).sum() + mixing.LAMBDA * (share * (r - 1) ** 2).sum()

    r = np.ones(40)
    for _ in range(20_000):
        r = np.maximum(0, r - 0.5 * (p @ ((share * r) @ p - target) + mixing.LAMBDA * (r - 1)))
    assert cost(got) == pytest.approx(cost(r), abs=1e-5)


def test_small_domains_meet_their_targets(spark):
    """Production settings, with domains of shares 0.78, 0.10 and 0.12: each total to 2 per cent of its target. Targets out of reach end too."""
    from llm import mixing

    domains = sorted(mixing.TARGETS)
    targets = [mixing.TARGETS[d] for d in domains]
    for sure in (1.0, 0.99):
        other = (1 - sure) / 2
        rows = [(n, *(sure if i == k else other for i in range(3))) for k, n in enumerate((7800, 1000, 1200))]
        cells = spark.createDataFrame(rows, "n long, p0 double, p1 double, p2 double")
        r = [x[0] for x in cells.select(mixing.rate(mixing.fit_rates(cells, targets), 3)).collect()]
        assert min(r) >= 0
        for k, target in enumerate(targets):
            assert sum(row[0] * row[1 + k] * x for row, x in zip(rows, r)) / 10_000 == pytest.approx(target, rel=0.02)
    vague = spark.createDataFrame([(7800, 0.8, 0.1, 0.1), (2200, 0.1, 0.5, 0.4)], "n long, p0 double, p1 double, p2 double")
    r = [x[0] for x in vague.select(mixing.rate(mixing.fit_rates(vague, targets), 3)).collect()]
    assert r[1] == 0 and r[0] > 1


def test_mixing_awkward(docs, empty, spark):
    from llm import mixing

    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert mixing.rates(docs, mixing.labelled_domains(none)).count() == len(ROWS)
    some = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (4, 1, None), (None, 1, 0), (6, None, None), (999, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    out = mixing.mixed(docs, mixing.labelled_domains(some))
    assert out.columns == docs.columns
    assert mixing.rates(empty, mixing.labelled_domains(some)).collect() == []


# ---- 4 and 7 --------------------------------------------------------------------------------------------------------


def pieces_of(text):
    from llm.tokens import encoder

    ids = encoder().full.encode(text or "", add_special_tokens=False).ids + [1]
    return [(k, s, ids[s : s + 4096]) for k, s in enumerate(range(0, len(ids), 4096))]


def test_pack_documents(docs, empty):
    from llm.packing import pack_documents

    rows = pack_documents(docs).collect()
    expected = sorted((str(i), k, s, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for i, t in ROWS for k, s, p in pieces_of(t))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 4096
    assert len(by) == -(-sum(r.length for r in rows) // 4096)
    assert pack_documents(empty).collect() == []


def test_many_districts(spark):
    """Slack of districts is pooled: no more sequences than the bound and a few."""
    from llm.packing import place

    rng = np.random.default_rng(5)
    n = rng.integers(1, 2500, 4000)
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(n)], "uid long, length long").repartition(4)
    out = place(df, 4096, district=400)
    assert out.count() == 4000
    assert out.select("sequence_id").distinct().count() <= -(-int(n.sum()) // 4096) + 2


def test_genetic_step_makes_the_solution(spark):
    """Triples that fill sequences exactly: crossovers end with fewer sequences than best-fit decreasing, and so does the whole placement."""
    from llm.packing import best_fit, evolve, place

    rng = np.random.default_rng(7)
    n = []
    for _ in range(250):
        a, b = rng.integers(1000, 1900, 2)
        n += [int(a), int(b), int(4096 - a - b)]
    lengths = np.array(n)
    plain = len(best_fit(np.argsort(-lengths), lengths, 4096))
    start = min(len(best_fit(np.random.default_rng(s).permutation(len(n)), lengths, 4096)) for s in range(6))
    assert len(evolve(lengths, 4096, 1)) < min(plain, start)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(n)], "uid long, length long")
    assert place(df, 4096).select("sequence_id").distinct().count() < plain


def test_pieces_that_never_fill(spark):
    """Lengths of which only one fits: every level ends some bins, so the levels end."""
    from llm.packing import place

    df = spark.createDataFrame([(i, 3000) for i in range(300)], "uid long, length long")
    assert place(df, 4096, district=20).select("sequence_id").distinct().count() == 300


def test_pack_sequences(docs, empty):
    from llm.packing import pack_sequences

    rows = pack_sequences(docs).collect()
    found = []
    for r in rows:
        ids = np.frombuffer(r.input_ids, "<u2").tolist()
        assert len(ids) == r.n_tokens == r.cu_seqlens[-1] <= 4096 and r.position_resets == r.cu_seqlens[:-1]
        found += [(str(d), k, ids[a:b]) for d, k, a, b in zip(r.doc_ids, r.pieces, r.cu_seqlens, r.cu_seqlens[1:])]
    assert sorted(found) == sorted((str(i), k, p) for i, t in ROWS for k, _, p in pieces_of(t))
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert pack_sequences(empty).collect() == []


def test_binary_files(docs, empty, tmp_path):
    """What is written and read back is what was packed."""
    from llm.packing import pack_sequences, read_matrix, stage, write_matrices

    packed = stage(pack_sequences(docs), "packed")
    at = f"file://{tmp_path}/ids"
    written = write_matrices(packed, at, pad=7).collect()
    found = set()
    for f in written:
        matrix, starts, lengths = read_matrix(at, f.file)
        assert matrix.shape == (f.rows, 4096) and int(lengths.sum()) == f.tokens
        for row, s, n in zip(matrix, starts, lengths):
            assert (row[n:] == 7).all()
            found.add((row[:n].tobytes(), tuple(s.tolist())))
    assert found == {(bytes(r.input_ids), tuple(r.position_resets)) for r in packed.collect()}
    assert write_matrices(pack_sequences(empty), f"file://{tmp_path}/none").collect() == []


# ---- 5 --------------------------------------------------------------------------------------------------------------


def test_quality(spark, corpus):
    from llm.queries import op5_quality

    rows = op5_quality(spark, SF.replace("0.001", "0.01")).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet").collect()}
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(a == b for a, b in held) / len(held) > 0.9


def test_quality_against_a_direct_fit(spark):
    """The whole query against features gathered in one place, numpy's least squares and a plain isotonic fit; and how well held-out labels are parted."""
    from llm import quality as q
    from llm.queries import op5_quality

    sf = SF.replace("0.001", "0.01")
    texts = dict(texts_of(spark.read.parquet(f"{sf}/documents.parquet")))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality is not None and r.doc_id in texts}
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    import pyarrow as pa

    ids = sorted(texts)
    x = q.statistics(pa.array([texts[i] for i in ids])).astype(np.float32).astype(float)
    at = {i: k for k, i in enumerate(ids)}
    train = [i for i in labels if fold(i)]
    t = x[[at[i] for i in train]]
    mean, scale = t.mean(0), np.sqrt(np.maximum((t**2).mean(0) - t.mean(0) ** 2, 1e-8))
    rng = np.random.default_rng(5)
    w, shift = rng.standard_normal((x.shape[1], q.D)) / (np.sqrt(x.shape[1]) * 1.5), rng.uniform(0, 2 * np.pi, q.D)
    z = np.column_stack([np.ones(len(x)), np.cos(np.clip((x - mean) / scale, -6, 6) @ w + shift) * np.sqrt(2 / q.D)])
    fit = [i for i in train if fold(i) != 1]
    a, y = z[[at[i] for i in fit]], np.array([labels[i] for i in fit], dtype=float)
    lam = q.RIDGE * len(fit) / q.D
    weights = np.linalg.lstsq(np.vstack([a, np.sqrt(lam) * np.eye(a.shape[1])]), np.append(y, np.zeros(a.shape[1])), rcond=None)[0]
    raw = z @ weights
    bins = collections.defaultdict(lambda: [0.0, 0])
    for i in train:
        if fold(i) == 1:
            k = int(min(max((raw[at[i]] + 0.5) / 2 * q.BINS, 0), q.BINS - 1))
            bins[k][0] += labels[i]
            bins[k][1] += 1
    pools = [[bins[k][0], bins[k][1], ((k + 0.5) / q.BINS * 2 - 0.5) * bins[k][1]] for k in sorted(bins)]
    merged = True
    while merged:  # neighbours that are out of order become one, until none is
        merged = False
        for k in range(len(pools) - 1):
            if pools[k][0] / pools[k][1] >= pools[k + 1][0] / pools[k + 1][1]:
                pools[k : k + 2] = [[u + v for u, v in zip(pools[k], pools[k + 1])]]
                merged = True
                break
    expected = np.clip(0.999 * np.interp(raw, [p[2] / p[1] for p in pools], [p[0] / p[1] for p in pools]) + 0.001 * np.clip(raw, 0, 1), 0, 1)
    found = {r.doc_id: r for r in op5_quality(spark, sf).collect()}
    assert len(found) == len(ids)
    assert np.mean([abs(found[i].score - expected[at[i]]) < 1e-3 for i in ids]) > 0.99
    good = [found[i].score for i in labels if not fold(i) and labels[i] == 1]
    bad = [found[i].score for i in labels if not fold(i) and labels[i] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95 and np.mean([found[i].predicted == 0 for i in labels if not fold(i) and labels[i] == 0]) > 0.8


def test_quality_awkward(docs, empty, spark):
    from llm import quality

    none = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(1, 1), (2, 1), (6, None), (8, 1), (10, 1)], "doc_id long, quality int")
    both = spark.createDataFrame([(i, i % 2) for i in range(1, 20)], "doc_id long, quality int")
    for labels in (none, one, both):
        stats = quality.document_statistics(docs)
        model = quality.fit(stats, labels)
        scores = quality.score_statistics(stats, model).collect()
        assert len(scores) == len(ROWS) and all(0 <= r.score <= 1 for r in scores)
        kept = quality.keep(docs, model, 0.3)
        assert kept.columns == docs.columns and kept.count() == sum(r.score >= 0.3 for r in scores)
    assert quality.score_statistics(quality.document_statistics(empty), model).collect() == []


# ---- 6 --------------------------------------------------------------------------------------------------------------


def test_media(docs, empty):
    from llm.media import Store, manifests, media_columns, payload_chunks, wrap

    rows = media_columns(docs).collect()
    assert len(rows) == len(ROWS)
    by = collections.defaultdict(set)
    for r in rows:
        by[r.doc_id].add(r)
    for i, t in ROWS:
        (r,) = by[i]
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(wrap(raw)), hashlib.sha256(wrap(raw)).hexdigest())
    assert media_columns(empty).collect() == []
    store = Store(docs.sparkSession)
    store.ingest(docs, manifests(docs))
    n = store.table().count()
    store.add(payload_chunks(docs))  # what is there isn't added again
    assert store.table().count() == n
    store.drop()


def test_media_features_and_lists(docs):
    """Chunk lists against a plain gear hash, byte by byte, and features against their definitions."""
    from llm import media as m

    def plain_cuts(x):
        out, start, h = [], 0, 0
        for i, byte in enumerate(x):
            h = ((h << 1) + int(m._GEAR[byte])) & 0xFFFFFFFF
            if i + 1 - start >= m.LEAST and (h >> 20 == 0 or i + 1 - start >= m.MOST):
                out.append(i + 1)
                start = i + 1
        return out if start == len(x) else [*out, len(x)]

    for _, t in ROWS:
        medium = m.wrap((t or "").encode())
        cuts = m.cuts(medium)
        assert cuts[-1] == len(medium) and b"".join(m.chunks(medium)) == medium
        if len(medium) > 4 * m.LEAST:
            # a cut no nearer than LEAST to the end
            assert [c for c in cuts if c < len(medium) - m.LEAST] == [c for c in plain_cuts(medium) if c < len(medium) - m.LEAST]
    rows = {r.doc_id: r for r in m.media_columns(docs).collect()}
    for i, t in ROWS:
        x = [b - 128 for b in m.samples(m.wrap((t or "").encode()))]
        counts = collections.Counter(x)
        rms, zcr = math.sqrt(sum(v * v for v in x) / len(x)), sum((a < 0) != (b < 0) for a, b in zip(x, x[1:])) / (len(x) - 1)
        entropy = -sum(c / len(x) * math.log2(c / len(x)) for c in counts.values())
        assert rows[i].feature == f"rms={rms:.4f} zcr={zcr:.4f} peak={max(map(abs, x))} entropy={max(0.0, entropy):.4f}"


def test_media_hot_chunks(spark, docs):
    """Entries of common chunks are dealt to copies: the same result."""
    from llm import media as m

    body = " ".join(f"m{i}" for i in range(3000))
    df = spark.createDataFrame([(i, f"{i} " + body) for i in range(40)], "doc_id long, text string")
    listed = m.stage(m.manifests(df), "manifests")
    lists = listed.where("media is not null").drop("sample")
    store = m.Store(spark)
    store.ingest(df, listed)
    a, b = (sorted(map(str, m.rebuilt(lists, store, hot).collect())) for hot in (3, 100_000))
    assert a == b and len(a) == 40
    store.drop()


# ---- 8 --------------------------------------------------------------------------------------------------------------


def test_fingerprints(docs, empty, corpus):
    from llm.fingerprint import edited_report, fingerprints

    for df in (docs, corpus[0]):
        rows = texts_of(df)
        by = {}
        for i, t in rows:
            by[i] = min(by.get(i, t or ""), t or "")
        order = sorted(by, key=lambda i: (i is not None, i or 0))
        after = {i: by[order[(k + 1) % len(order)]] for k, i in enumerate(order)}
        canon = lambda t: " ".join(unicodedata.normalize("NFKC", t).upper().lower().split())
        found = edited_report(df).collect()
        assert len(found) == len(rows)
        expected = collections.Counter()
        for i, t in rows:
            t = t or ""
            k = len(t) // 4
            e = t[: len(t) - k] + after[i][:k]
            expected[i, len(t), hashlib.sha256(e.encode()).hexdigest(), float(canon(e) == canon(t)), float(canon(t) == canon(after[i]))] += 1
        assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in found) == expected
        same = collections.defaultdict(set)
        for i, t in rows:
            same[canon(t or "")].add(i)
        prints = fingerprints(df.where("doc_id is not null")).collect()
        assert len({r.fingerprint for r in prints}) == len([1 for v in same.values() if v - {None}])
    assert edited_report(empty).collect() == []


def test_fingerprint_collisions(spark):
    """Documents whose digests collide are told apart by their bytes."""
    from llm.fingerprint import classes

    texts = spark.createDataFrame([(1, "a", "f", 7), (2, "b", "f", 8), (3, "a", "f", 7), (4, "c", "g", 7), (5, "d", "f", 7)], "doc_id long, canon string, fingerprint string, key long")
    assert sorted((r.fingerprint, r.key, r.class_id) for r in classes(texts).collect()) == [("f", 7, 1), ("f", 7, 5), ("f", 8, 2), ("g", 7, 4)]


#: Rows that share ids with different texts, many without an id, and columns with names that the operators use themselves.
AGAIN = [(1, SHARED), (5, "aa " + SHARED), (5, "zz short text"), (2, BASE), (2, SHARED + " beta"), (3, BASE + " more"), (3, BASE), (7, "alpha"), (8, "alpha"), (8, "beta"), (9, "beta"), *[(None, f"n{i % 3} " + BASE[: 40 * i]) for i in range(9)], (None, None), (None, "")]
CLASH = ("doc", "turn", "spans", "row", "at", "lo", "hi", "later", "first", "fingerprint", "canon", "key", "same", "tid", "rate", "_row", "f0", "uid", "length", "batch", "a.b")


@pytest.fixture(scope="module")
def again(spark):
    rows = [(i, t, *range(len(CLASH)), len(t or "")) for i, t in AGAIN]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in CLASH) + ", n_chars int").repartition(3)


def test_fingerprints_of_repeated_ids(again):
    from llm.fingerprint import edited_report, fingerprints

    canon = lambda t: " ".join((t or "").upper().lower().split())
    classes = collections.defaultdict(list)
    for i, t in AGAIN:
        classes[canon(t)].append(i)
    least = {c: min((i for i in v if i is not None), default=None) for c, v in classes.items()}
    assert collections.Counter((r.doc_id, r.class_id) for r in fingerprints(again).collect()) == collections.Counter((i, least[canon(t)]) for i, t in AGAIN)
    ids = sorted({i for i, _ in AGAIN}, key=lambda i: (i is not None, i or 0))
    after = {i: min(t or "" for j, t in AGAIN if j == ids[(k + 1) % len(ids)]) for k, i in enumerate(ids)}
    expected = collections.Counter()
    for i, t in AGAIN:
        t = t or ""
        e = t[: len(t) - len(t) // 4] + after[i][: len(t) // 4]
        expected[i, len(t), hashlib.sha256(e.encode()).hexdigest(), float(canon(e) == canon(t)), float(canon(t) == canon(after[i])), least[canon(t)]] += 1
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next, r.class_id) for r in edited_report(again).collect()) == expected


# ---- 9 --------------------------------------------------------------------------------------------------------------


def brute_classes(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])
    ids, label = sorted(sets), {i: i for i in sets}
    find = lambda i: i if label[i] == i else find(label[i])
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_near_duplicates(docs, corpus, empty):
    from llm.neardup import near_duplicates

    for df in (docs, corpus[0]):
        rows = texts_of(df)
        found = near_duplicates(df).collect()
        assert len(found) == len(rows)
        assert {r.doc_id: r.class_id for r in found if r.doc_id is not None} == brute_classes([r for r in rows if r[0] is not None])
        assert all(r.class_id is None for r in found if r.doc_id is None)
    assert near_duplicates(empty).collect() == []


def test_near_duplicates_of_repeated_ids(again):
    """Each row is in the class of its own text, and one row of each class stays."""
    from llm.neardup import first_of_each, near_duplicates

    numbered = [(k, t) for k, (i, t) in enumerate(AGAIN) if i is not None]
    label = brute_classes(numbered)
    least = collections.defaultdict(lambda: 1 << 60)
    for k, _ in numbered:
        least[label[k]] = min(least[label[k]], AGAIN[k][0])
    expected = collections.Counter((AGAIN[k][0], least[label[k]]) for k, _ in numbered)
    found = near_duplicates(again).collect()
    assert collections.Counter((r.doc_id, r.class_id) for r in found if r.doc_id is not None) == expected and len(found) == len(AGAIN)
    kept = first_of_each(again).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(least.values()) and sum(r.doc_id is None for r in kept) == 11
    assert {(r.doc_id, r.text) for r in kept} <= set(AGAIN) and all(tuple(r)[2:-1] == tuple(range(len(CLASH))) for r in kept)


def test_chain_of_near_copies(spark):
    """A group of copies that each differ a little more: all linked, over each other."""
    from llm.neardup import near_duplicates

    words = [f"t{i}" for i in range(200)]
    rows = []
    for k in range(30):
        rows.append((100 + (k * 7) % 30, " ".join(words)))
        words[(k * 37) % 200] = f"changed{k}"
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in found} == set(brute_classes(rows).values())


def test_pairs_in_a_family_below_the_threshold(spark):
    """Hundreds of texts that are alike to 0.75 share buckets without links; each has one partner at 0.83, which has to be found."""
    from llm.neardup import near_duplicates

    common, rows = [f"c{i}" for i in range(304)], []
    for k in range(400):
        pair = [f"p{k}x{i}" for i in range(18)]
        rows += [(2 * k + e, " ".join(common + pair + [f"o{k}x{e}x{i}" for i in range(32)])) for e in (0, 1)]
    assert brute_classes(rows[:40]) == {i: i - i % 2 for i in range(40)}
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in found} == {i: i - i % 2 for i, _ in rows}


# ---- 10 -------------------------------------------------------------------------------------------------------------


def brute_url(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = rest[:end], rest[end:]
        path = tail[: min([tail.index(c) for c in "?#" if c in tail] or [len(tail)])]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
    fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    return host, path, best and best[1] + best[2], best and best[0]


ODD_URLS = [None, "", "no scheme", "http://", "http://net", "http://net/", "HTTP://A.NET/x?y", "http://example.net/en", "http://www.example.net/en/a#b", "http://notexample.net/en/x", "http://EXAMPLE.com/de/", "x://y.org/fr/://z", "http://é.org/fr/ü", "http://a.org?q=/fr/", "http://a.org#x", "://org/fr/", "http://a\nb.org/fr/\n1"]


def test_url_rules(spark):
    from llm.url_filter import judge

    rows = [(k, u, "clash") for k, u in enumerate(ODD_URLS)] + [(0, ODD_URLS[6], "again"), (None, ODD_URLS[8], "x"), (5, ODD_URLS[5], "copy")]
    found = judge(spark.createDataFrame(rows, "page_id long, url string, gram string")).collect()
    expected = collections.Counter((i, *brute_url(u)[:3]) for i, u, _ in rows)
    assert collections.Counter((r.page_id, r.host, r.path, r.rule) for r in found) == expected
    for r in found:
        assert r.verdict in ("allow", "block") and (r.rule is None or r.verdict == ("allow" if r.rule in ("example.net/en/", "org/fr/") else "block"))
    assert judge(spark.createDataFrame([], "page_id long, url string")).collect() == []
    assert {r.verdict for r in judge(spark.createDataFrame([(1, "http://plain.com/a")], "page_id long, url string")).collect()} == {"allow"}


def test_url_model(spark):
    """Scores against a plain computation of the same model; urls that look like blocked ones are blocked."""
    from llm import url_filter as u

    pages = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/pages.parquet")
    rows = [(r.page_id, r.url) for r in pages.select("page_id", "url").collect()]
    code = lambda c: u.ALPHABET.find(c) + 1
    grams = lambda url: [(a * u.K + b) * u.K + c for a, b, c in zip(*(lambda s: (s, s[1:], s[2:]))([u.END] * 2 + [code("".join(x.lower() if "A" <= x <= "Z" else x for x in ch)) for ch in url or ""] + [u.END]))]
    known = [(url, brute_url(url)[3] == "allow") for _, url in rows if brute_url(url)[3] and zlib.crc32(url.encode()) % 5]
    n = {ok: collections.Counter(g for url, k in known if k == ok for g in grams(url)) for ok in (True, False)}

    def p(g, c, mass=4.0):
        a, b, last = g // u.K, g // u.K % u.K, g % u.K
        one = (sum(v for k, v in c.items() if k % u.K == last) + 1) / (sum(c.values()) + u.K)
        two = (sum(v for k, v in c.items() if k % (u.K * u.K) == b * u.K + last) + mass * one) / (sum(v for k, v in c.items() if k // u.K % u.K == b) + mass)
        return (c[g] + mass * two) / (sum(v for k, v in c.items() if k // u.K == a) + mass)

    found = {r.page_id: r.score for r in u.judge(pages).collect()}
    for i, url in rows[:12]:
        g = grams(url)
        assert found[i] == pytest.approx(np.mean([math.log(p(x, n[True]) / p(x, n[False])) for x in g]), abs=1e-9)


# ---- SQL ------------------------------------------------------------------------------------------------------------


def test_sql(spark):
    """Queries with SQL against it."""
    import duckdb

    from llm.queries import ORACLE, QUERIES

    base = duckdb.connect()
    for t in ("documents", "pages"):
        base.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in ORACLE.items():
        r = base.execute(sql)
        names = [x[0] for x in r.description]
        df = QUERIES[name](spark, SF)
        assert sorted(names) == sorted(df.columns)
        assert sorted(tuple(x) for x in df.select(*names).collect()) == sorted(r.fetchall())


# ---- the pipeline ---------------------------------------------------------------------------------------------------


def test_pipeline(spark, corpus):
    import corpus_pipeline as c

    docs = corpus[0]
    assert [n for n, _ in c.STAGES] == ["quality", "near_duplicates", "substrings", "mixing", "packing"]
    seen = {}
    for name, f in c.STAGES[:-1]:
        out = f(spark, docs, SF)
        assert out.columns == docs.columns
        out.write.mode("overwrite").parquet(at := f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}")
        docs = spark.read.parquet(at)
        seen[name] = texts_of(docs)
    classes = brute_classes(seen["quality"])
    assert sorted(i for i, _ in seen["near_duplicates"]) == sorted({v for v in classes.values()})
    expected = {i: s for i, _, _, s in brute_substrings(seen["near_duplicates"])}
    assert {i: hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest() for i, t in seen["substrings"]} == expected
    assert set(seen["mixing"]) <= set(seen["substrings"])
    assert c.run(spark, SF).agg(F.sum("length")).first()[0] == sum(len(p) for _, t in seen["mixing"] for _, _, p in pieces_of(t))
