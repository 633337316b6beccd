import random
import re

from oracle import assert_same, connection

from plumbline.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, hit = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            hit |= {i + k for i in at for k in range(3)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_features(docs):
    rng = random.Random(1)
    texts = [None, "", " \n\t", "a", "a b c a b c", "x\n x\nx\n\nx", "#a *b|c <é>", "a a a a a", "  b\x1c c", "w " * 40_000, "é" * 200_000]
    texts += [rng.choice(["\n", " ", " \n"]).join(rng.choice(["a", "b", "c#", "dé"]) for _ in range(rng.randrange(90))) for _ in range(80)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, "again"), (None, "no id")]
    got = {(r["doc_id"], r["n_words"]): r for r in quality.judged(docs(rows)).collect()}
    for i, t in rows:
        want = brute(t)
        r = got[i, want[0]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want, t[:50]
    assert quality.judged(docs([])).count() == 0


def corpus_of_hosts():
    rng = random.Random(6)
    good = lambda: " ".join(f"w{rng.randrange(9999)}" for _ in range(60))
    junk = lambda: " ".join(f"#w{rng.randrange(9999)}#" for _ in range(60))
    rows = [(i, junk() if i % 5 else good(), "en", "junk") for i in range(200)]  # four fifths symbols, none of it base_failed
    rows += [(1000 + i, good() if i % 20 else "few", "en", f"h{i % 25}") for i in range(1500)]
    rows += [(5000 + i, junk(), "en", "tiny") for i in range(2)] + [(6000, good(), "en", None), (6001, junk(), "en", None), (6002, good(), "en", "rare")]
    return rows


def test_a_bad_host_loses_its_documents_in_the_query(spark, docs, tmp_path):
    rows = corpus_of_hosts()
    docs(rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = quality.query(spark, str(tmp_path))
    assert_same(found, connection(str(tmp_path)), quality.SQL)
    got = {r["doc_id"]: r for r in found.collect()}
    assert not any(got[i]["kept"] for i in range(200)) and not any(got[i]["base_failed"] for i in range(200))
    assert all(got[1000 + i]["kept"] == bool(i % 20) for i in range(1500))  # ordinary hosts keep their good documents
    assert got[6000]["kept"] and got[6001]["kept"] and got[6002]["kept"]


def plain_prior(sizes, failed):
    """Mean and within-host correlation by moments, written out."""
    n, k = sum(sizes), len(sizes)
    m = sum(failed) / n
    spread = sum(a * (f / a - m) ** 2 for a, f in zip(sizes, failed, strict=True))
    expected_by_chance = m * (1 - m) * sum(1 - a / n for a in sizes)
    per_rho = m * (1 - m) * sum((a - 1) * (1 - a / n) for a in sizes)
    return m, (spread - expected_by_chance) / per_rho


def test_prior_has_no_noise_of_sampling():
    rng = random.Random(3)
    for rho, trials in ((0.0, 40), (0.2, 40)):
        found = []
        for _ in range(trials):
            sizes = [rng.randrange(2, 30) for _ in range(300)]
            failed = []
            for a in sizes:
                p = 0.1 if rho == 0 else rng.betavariate(0.1 * (1 / rho - 1), 0.9 * (1 / rho - 1))
                failed.append(sum(rng.random() < p for _ in range(a)))
            m, want = plain_prior(sizes, failed)
            mean, weight = quality.prior(sum(sizes), sum(a * a for a in sizes), len(sizes), sum(failed), sum(f * f / a for a, f in zip(sizes, failed, strict=True)))
            assert abs(mean - m) < 1e-12 and abs(1 / (1 + weight) - min(max(want, quality.LEAST), quality.MOST)) < 1e-9
            found.append(want)
        assert abs(sum(found) / trials - rho) < 0.02  # binomial noise alone gives no spread
    assert quality.prior(0, 0, 0, 0, 0) == (0.0, 1 / quality.LEAST - 1)
    assert quality.limit(0.0) == 0.5 and quality.limit(1.0) == 1.0 and quality.limit(0.3) > 0.8


def test_hosts(docs):
    got = {r["host"]: r for r in quality.hosts(quality.features(docs(corpus_of_hosts()))).collect()}
    assert None not in got and not got["junk"]["good"] and got["rare"]["good"]
    assert got["junk"]["symbols_rate"] < 0.8 and got["rare"]["symbols_rate"] > 0  # both shrunk towards the corpus
    assert quality.hosts(quality.features(docs([(1, "few", "en", None)]))).count() == 0
    alone = quality.judged(docs([(i, "few" if i else " ".join(f"w{k}" for k in range(60)), "en", "h") for i in range(30)])).collect()
    assert [r["doc_id"] for r in alone if r["kept"]] == [0]
