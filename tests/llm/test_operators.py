import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytofabric.llm import chat_tree, components, exact_dedup, license_scan, nn_descent, pack, partenum, pfair_mix, piece_bpe, quality_fm, url_reputation
from cytofabric.llm.common import alnum_words, blank_words

from .conftest import sentence


def rows(df, *keys):
    return sorted((tuple(r[k] for k in keys) if keys else tuple(r) for r in df.collect()), key=str)


# 1 licence scan


def naive_places(words):
    return sorted((i, label) for phrase, label in license_scan.BASE.items() for q in [alnum_words(phrase)] for i in range(len(words)) if words[i : i + len(q)] == q)


def test_licence_places_are_all_places():
    automaton = license_scan.LicenceAutomaton(license_scan.BASE, license_scan.TEMPLATES)
    rng = random.Random(3)
    vocabulary = [w.encode() for w in "gnu general public license apache cc by mit licensed under the version 2 0 x".split()]
    for _ in range(400):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        assert sorted((s[2], s[0]) for s in automaton.scan(words) if s[1]) == naive_places(words)


def test_licence_chain_bridges_changed_words():
    automaton = license_scan.LicenceAutomaton(license_scan.BASE, license_scan.TEMPLATES)
    text = license_scan.TEMPLATES["bsd"].replace("with or without modification", "changed or not")
    found = [s for s in automaton.scan(alnum_words("before it " + text)) if s[0] == "bsd"]
    assert found and found[0][2] == 2 and 0.6 <= found[0][4] < 1


def test_whole_licences_are_covered():
    automaton = license_scan.LicenceAutomaton(license_scan.BASE, license_scan.TEMPLATES)
    for name in ("mit", "isc", "bsd", "unlicense", "zlib"):
        words = alnum_words("x y " + license_scan.TEMPLATES[f"{name}-whole"] + " z")
        assert (name, False, 2, len(words) - 3, 1.0) in automaton.scan(words)


def test_matching_statistics_are_the_longest_matches():
    automaton = license_scan.LicenceAutomaton({"a b": "x"}, {"t": "a b c a b d", "u": "b c b a"})
    texts = [t.split() for t in ("a b", "a b c a b d", "b c b a")]
    rng = random.Random(4)
    for _ in range(300):
        words = rng.choices("abcde", k=rng.randint(0, 25))
        want = [(i, max((n for n in range(1, i + 1) if any(t[j : j + n] == words[i - n : i] for t in texts for j in range(len(t)))), default=0)) for i in range(1, len(words) + 1)]
        assert [(end, n) for end, _, n in automaton.matches([w.encode() for w in words])] == [x for x in want if x[1]]


def test_chain_is_the_best_one():
    rng = random.Random(6)
    gap = license_scan.MAX_GAP
    for _ in range(200):
        pieces = sorted({(rng.randint(0, 40), rng.randint(0, 40), rng.randint(4, 9)) for _ in range(rng.randint(1, 7))})
        best = 0
        for r in range(1, len(pieces) + 1):
            for chain in itertools.combinations(pieces, r):
                total, ok = chain[0][2], True
                for (d0, t0, n0), (d, t, n) in itertools.pairwise(chain):
                    over = max(0, d0 + n0 - d, t0 + n0 - t)
                    ok &= d0 < d and t0 < t and over < n and d - d0 - n0 <= gap and t - t0 - n0 <= gap
                    total += n - over
                best = max(best, total) if ok else best
        assert license_scan.LicenceAutomaton._chain(pieces)[0] == best


def test_licence_scan_of_odd_rows(odd_documents, no_documents):
    out = {r.doc_id: r for r in license_scan.scan_licences(odd_documents).collect()}
    assert out[3].n_words == out[4].n_words == 0 and out[4].spans == []
    assert [s.label for s in out[9].spans if s.base] == ["mit", "cc-by", "cc-by"]
    assert license_scan.scan_licences(odd_documents).count() == 12 and license_scan.scan_licences(no_documents).count() == 0


# 2 NN-descent


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 16))
    base = np.vstack([base, base[:20] + rng.normal(scale=0.05, size=(20, 16)), base[5] + rng.normal(scale=0.03, size=(90, 16)), base[7:8], base[7:8] * 3])
    good = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    bad = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] + [1.0] * 15), (1004, [float("inf")] + [1.0] * 15), (None, good[3][1]), (7, good[7][1])]
    return base, spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").withColumn("rep", F.lit(1))


def test_nn_descent_finds_the_links_of_brute_force(vectors):
    base, df = vectors
    unit = base / np.linalg.norm(base, axis=1)[:, None]
    link = unit @ unit.T >= 0.9
    np.fill_diagonal(link, False)
    parent = list(range(len(base)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in zip(*np.nonzero(link), strict=True):
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    out = nn_descent.near_duplicates(df).collect()
    assert len(out) == df.count() and out[0].recall >= 0.95
    found = {r.vec_id: r for r in out if r.vec_id is not None and r.vec_id < 1000 and r.vec_id != 7}
    wrong = [i for i, r in found.items() if r.component_id != find(i)]
    assert not wrong
    more = link[:, 7].astype(int) + link[:, 3]  # the repeated row of vector 7, and that of vector 3 without an id
    more[3] += 1
    assert not [i for i, r in found.items() if r.n_links != link[i].sum() + more[i]] and out[0].recall == 1.0
    assert [(r.component_id, r.kept) for r in out if r.vec_id is None] == [(3, False)]
    assert all(r.n_links == 0 and r.component_id == r.vec_id and r.kept for r in out if r.vec_id is not None and r.vec_id >= 1000)


def test_nn_descent_takes_rows_of_any_size_and_width(spark):
    up, right = [1.0, 1.0], [1.0, -1.0]
    data = [(1, up), (2, [1e200, 1e200]), (3, [3e-200, 3e-200]), (4, right), (4, up), (5, [1e300, -1e300]), (6, [1.0, 1.0, 1.0]), (7, [2.0, 2.0, 2.0]), (8, []), (9, None), (10, [1.0])]
    out = nn_descent.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("cls", F.lit(1)))
    got = rows(out, "vec_id", "n_links", "component_id")
    assert got == sorted([(1, 3, 1), (2, 3, 1), (3, 3, 1), (4, 1, 4), (4, 3, 1), (5, 1, 4), (6, 1, 6), (7, 1, 6), (8, 0, 8), (9, 0, 9), (10, 0, 10)], key=str)


def test_nn_descent_of_nothing(vectors):
    assert nn_descent.near_duplicates(vectors[1].limit(0)).count() == 0


@pytest.fixture(scope="module")
def rare_pairs(spark):
    """4000 vectors of which 12 have a near copy."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(4000, 32))
    base[3988:] = base[:12] + rng.normal(scale=0.3, size=(12, 32))
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "vec_id long, embedding array<double>").repartition(4)


def test_audit_of_rare_links_is_no_guess(spark, rare_pairs):
    _, points = nn_descent.classes_of(rare_pairs.where("vec_id < 11 or vec_id between 100 and 3988"), "vec_id", "embedding")
    links, full = spark.createDataFrame([], "id long, other long"), spark.createDataFrame([], "rep long")
    assert [nn_descent.audit_recall(points, links, full, 0.9, seed) for seed in range(3)] == [0.0] * 3
    _, points = nn_descent.classes_of(rare_pairs.where("vec_id between 100 and 400"), "vec_id", "embedding")
    assert nn_descent.audit_recall(points, links, full, 0.9, 0) == 1.0


def test_recall_is_always_measured(spark, rare_pairs, monkeypatch):
    """The first vectors audited have no link: the audit goes on until it has met one, or all vectors."""
    monkeypatch.setattr(nn_descent, "AUDIT", 10)
    monkeypatch.setattr(nn_descent, "AUDIT_LEAST", 10)
    links, full = spark.createDataFrame([], "id long, other long"), spark.createDataFrame([], "rep long")
    for few, want in ((rare_pairs.where("vec_id between 100 and 200"), 1.0), (rare_pairs.where("vec_id = 3 or vec_id = 3991 or vec_id between 100 and 200"), 0.0)):
        _, points = nn_descent.classes_of(few, "vec_id", "embedding")
        assert nn_descent.audit_recall(points, links, full, 0.9, 0) == want


def test_dense_groups_beyond_the_longest_list(spark):
    """Groups of more linked vectors than a list holds, loose ones and a bridge: every count and component is that of brute force."""
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(5, 12))
    base = np.vstack([rng.normal(size=(1200, 12)), *(c + rng.normal(scale=s, size=(m, 12)) for c, m, s in zip(centres, (400, 300, 200, 90, 60), (0.05, 0.15, 0.25, 0.3, 0.1), strict=True)), centres[:1] + centres[1:2]])
    unit = base / np.linalg.norm(base, axis=1)[:, None]
    link = unit @ unit.T >= 0.9
    np.fill_diagonal(link, False)
    least = np.arange(len(base))
    while True:
        lower = np.minimum(least, np.where(link, least[None, :], len(base)).min(1))
        if (lower == least).all():
            break
        least = lower
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "vec_id long, embedding array<double>").repartition(5)
    out = nn_descent.near_duplicates(df).collect()
    assert link.sum(1).max() > 3 * nn_descent.LAST_K and out[0].recall >= 0.98
    assert [(r.vec_id, r.n_links, r.component_id) for r in out if (r.n_links, r.component_id) != (link[r.vec_id].sum(), least[r.vec_id])] == []


@pytest.mark.parametrize("rounds", [24, 2])
def test_nn_descent_finds_rare_pairs(rare_pairs, monkeypatch, rounds):
    monkeypatch.setattr(nn_descent, "PROJECTIONS", 1)
    monkeypatch.setattr(nn_descent, "BLOCK", 16)
    monkeypatch.setattr(nn_descent, "MOST_ROUNDS", rounds)
    out = nn_descent.near_duplicates(rare_pairs).where("n_links > 0").collect()
    assert {(r.vec_id, r.n_links, r.component_id) for r in out} == {(i, 1, i % 3988) for i in [*range(12), *range(3988, 4000)]}
    assert out[0].recall >= 0.98


# 3 factorisation machine


def test_fm_margin_is_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    size = quality_fm.WORD_BUCKETS + quality_fm.BINS * len(quality_fm.STATISTICS)
    fm = quality_fm.FactorisationMachine(0.3, rng.normal(size=size), rng.normal(size=(size, quality_fm.RANK)))
    at, ids, x = quality_fm.features(["One two two three!", "", None], [5, None, float("nan")])
    for r, margin in enumerate(fm.margins(at, ids, x)):
        j, v = ids[at[r] : at[r + 1]], x[at[r] : at[r + 1]]
        pairs = sum(fm.factors[a] @ fm.factors[b] * p * q for (a, p), (b, q) in itertools.combinations(list(zip(j, v, strict=True)), 2))
        assert margin == pytest.approx(0.3 + fm.linear[j] @ v + pairs)


def test_classifier_separates_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = quality_fm.op3_quality_fm(spark, sf).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = out[out.quality == 1].score.to_numpy(), out[out.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.9
    assert (out[out.quality == 1].predicted == 1).mean() > 0.95


def test_classifier_without_labels_and_with_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    out = quality_fm.classify(odd_documents, labels).collect()
    assert len(out) == 12 and {r.score for r in out} == {0.5} and {r.predicted for r in out} == {1}
    labels = spark.createDataFrame([(i, i % 2) for i in range(11)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality_fm.classify(odd_documents, labels).collect())
    assert quality_fm.classify(no_documents, labels).count() == 0
    kept = quality_fm.keep_good(odd_documents, labels)
    assert kept.columns == odd_documents.columns


# 4 exact dedup


def test_exact_dedup_keeps_the_largest_id(odd_documents, no_documents):
    out = {r.doc_id: r for r in exact_dedup.exact_dedup(odd_documents).collect() if r.doc_id != 7}
    assert (out[1].keep_id, out[1].group_size, out[1].kept, out[2].kept) == (2, 2, False, True)
    assert out[3].keep_id == 4 and out[3].text_sha256 == out[4].text_sha256 == hashlib.sha256(b"").hexdigest()
    assert out[None].keep_id is None and out[None].kept
    assert exact_dedup.exact_dedup(no_documents).count() == 0
    kept = exact_dedup.keep_first_copies(odd_documents)
    assert kept.columns == odd_documents.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 4, 5, 6, 7, 8, 9, 10]


def test_later_batches_meet_the_index(spark):
    index = exact_dedup.DigestIndex(spark)
    one = spark.createDataFrame([(5, "a"), (6, "a"), (7, "b")], "doc_id long, text string")
    two = spark.createDataFrame([(90, "a"), (91, "c"), (92, "c")], "doc_id long, text string")
    assert rows(exact_dedup.exact_dedup(one, index), "doc_id", "keep_id", "group_size", "kept") == [(5, 6, 2, False), (6, 6, 2, True), (7, 7, 1, True)]
    assert rows(exact_dedup.exact_dedup(two, index), "doc_id", "keep_id", "group_size", "kept") == [(90, 6, 3, False), (91, 92, 2, False), (92, 92, 2, True)]
    assert index.read().count() == 3


def test_a_batch_run_again_gives_the_same(spark):
    index = exact_dedup.DigestIndex(spark)
    docs = spark.createDataFrame([(5, "a"), (6, "a"), (7, "b")], "doc_id long, text string")
    first = rows(exact_dedup.exact_dedup(docs, index, "monday"))
    assert rows(exact_dedup.exact_dedup(docs, index, "monday")) == first and index.read().count() == 2
    assert [r.kept for r in exact_dedup.exact_dedup(docs, index, "tuesday").collect()] == [False] * 3
    assert sorted(r.doc_id for r in exact_dedup.keep_first_copies(docs.union(docs), index, "monday").collect()) == [6, 7]
    before = spark.catalog.listTables()
    exact_dedup.exact_dedup(docs).collect()
    assert len(spark.catalog.listTables()) == len(before)


def test_the_index_is_read_in_its_order(spark):
    """Settled buckets are one sorted file each: the join sorts the batch only, and never broadcasts."""
    index = exact_dedup.DigestIndex(spark, buckets=4)
    docs = spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") % 300).cast("string").alias("text"))
    exact_dedup.exact_dedup(docs, index).collect()
    settled, recent = (level.count() for level in index.levels())
    assert (settled, recent) == (300, 0)
    batch = docs.select(exact_dedup.digest_of("text").alias("digest"), F.col("doc_id").alias("largest"), F.lit(1).alias("copies"))
    with exact_dedup.sorted_scans(spark):
        plan = batch.join(index.levels()[0].select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
        anti = index.met(batch, "left_anti")[0]
        assert anti.count() == 0
    assert plan.count("SortMergeJoin") == 1 and plan.count("Sort [") == 1 and plan.count("Exchange") == 1 and "Broadcast" not in plan


def test_the_index_in_a_later_session(spark):
    name = "digest_index_kept"
    one = spark.createDataFrame([(5, "a"), (6, "a"), (7, "b")], "doc_id long, text string")
    exact_dedup.exact_dedup(one, exact_dedup.DigestIndex(spark, name)).collect()
    later = spark.newSession()
    index = exact_dedup.DigestIndex(later, name)
    two = later.createDataFrame([(90, "a"), (91, "c")], "doc_id long, text string")
    assert rows(exact_dedup.exact_dedup(two, index), "doc_id", "keep_id", "group_size", "kept") == [(90, 6, 3, False), (91, 91, 1, True)]
    index.settle(always=True)
    assert rows(exact_dedup.exact_dedup(two, index), "doc_id", "keep_id", "group_size", "kept") == [(90, 6, 3, False), (91, 91, 2, False)]
    index._create(index.coming)  # a merge that broke off before it was whole leaves the index as it was
    assert exact_dedup.DigestIndex(later, name).read().count() == 3 and not later.catalog.tableExists(index.coming)
    index._create(index.coming)
    index.read().write.insertInto(index.coming)
    later.sql(f"ALTER TABLE {index.coming} SET TBLPROPERTIES ('whole' = 'true')")
    index.spark.sql(f"DROP TABLE {index.recent}")  # one that broke off afterwards is ended
    again = exact_dedup.DigestIndex(later, name)
    assert again.read().count() == 3 and not later.catalog.tableExists(again.coming)
    again.drop()


# 5 URL reputation


def test_domains_and_suffixes(spark):
    hosts = ["www.a.co.uk", "a.com", "b.a.com:8080", "me@b.a.com", "localhost", "10.0.0.1:80", "x.y.city.kobe.jp", "co.uk", ""]
    df = spark.createDataFrame(list(enumerate(hosts)), "i long, host string")
    df = df.join(url_reputation.suffix_labels(df, ["city.kobe.jp", "kobe.jp", "jp", "none.such.suffix.at.all"]), "host", "left")
    d, s = url_reputation.domain_and_suffix(F.col("host"), listed_labels=F.col("labels_"))
    assert [tuple(r) for r in df.orderBy("i").select(d, s).collect()] == [
        ("a.co.uk", "co.uk"), ("a.com", "com"), ("a.com", "com"), ("a.com", "com"), ("localhost", "localhost"), ("10.0.0.1", "10.0.0.1"), ("y.city.kobe.jp", "city.kobe.jp"), ("co.uk", "co.uk"), ("", ""),
    ]


def test_long_and_repeated_urls(spark):
    pages = spark.createDataFrame([(1, "https://a.org/" + "x" * 300_000), (1, "https://a.org/y"), (None, "https://a.org/y")], "page_id long, url string").withColumn("host", F.lit("clash"))
    out = url_reputation.filter_urls(pages, spark.createDataFrame([], "host string, bad int")).collect()
    assert sorted((r.page_id or 0, r.host, len(r.path), r.rule) for r in out) == [(0, "a.org", 2, "org/"), (1, "a.org", 2, "org/"), (1, "a.org", 300_001, "org/")]


def test_hosts_and_rules(spark):
    urls = ["https://WWW.Example.org/es/1?x", "http://a.example.org/en/17#t", "ftp://b.com/fr/", "no scheme", None, "x://h.net", "y://h.com/de/9/a?b#c", "z://fooexample.org/es/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    none = spark.createDataFrame([], "host string, bad int")
    out = {r.page_id: r for r in url_reputation.filter_urls(pages, none).collect()}
    assert [(out[i].host, out[i].path, out[i].rule, out[i].verdict) for i in range(8)] == [
        ("www.example.org", "/es/1", "example.org/es/", "block"), ("a.example.org", "/en/17", "example.org/en/1", "block"), ("b.com", "/fr/", "com/fr/", "allow"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("h.net", "", None, "allow"), ("h.com", "/de/9/a", "com/de/", "block"), ("fooexample.org", "/es/", "org/", "allow"),
    ]
    assert url_reputation.filter_urls(pages.limit(0), none).count() == 0


def test_many_rules_are_the_plain_search(spark):
    """Thousands of rules and suffixes, a list or a table, against a loop over all of them; hosts with many dots, empty labels and clashing columns."""
    rng = random.Random(8)
    label = lambda: rng.choice(["a", "b", "c", "de", "org", "co", ""])
    name = lambda n: ".".join(label() for _ in range(rng.randint(1, n)))
    path = lambda: "/" + "/".join(rng.choice("xyz") for _ in range(rng.randint(0, 3)))
    rules = list({name(3) + path(): rng.choice(["allow", "block"]) for _ in range(4000)}.items())
    urls = [f"https://{name(5)}{path()}" for _ in range(300)] + ["https://" + "a." * 20_000 + "org/x", "https://a", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({c: F.lit("clash") for c in ("host", "path", "rule", "rules_", "end_", "labels_")})
    none = spark.createDataFrame([], "host string, bad int")
    found = {r.page_id: (r.rule, r.verdict) for r in url_reputation.filter_urls(pages, none, rules, suffixes=["co.org", "b"]).collect()}
    assert found == {r.page_id: (r.rule, r.verdict) for r in url_reputation.filter_urls(pages, none, spark.createDataFrame(rules, "rule string, verdict string")).collect()}
    for i, url in enumerate(urls):
        host, _, rest = (url or "://").split("://")[1].partition("/")
        fit = [r for r in rules for n, _, at in [r[0].partition("/")] if (host == n or host.endswith("." + n)) and (("/" + rest) if url and "/" in url[8:] else "").startswith("/" + at)]
        best = max(fit, key=lambda r: (len(r[0]), r[0]), default=(None, "allow"))
        assert found[i] == best, url
    assert {v for _, v in url_reputation.filter_urls(pages, none, []).select("rule", "verdict").collect()} == {"allow"}


def test_reputation_shrinks_and_blocks(spark):
    hosts = [("bad.spam.net", 40, 39), ("new.spam.net", 0, 0), ("www.good.net", 500, 5), ("few.good.net", 1, 1), ("x.other.org", 30, 1)]
    out = {r.host: r for r in url_reputation.host_reputation(spark.createDataFrame([(h, float(n), float(b)) for h, n, b in hosts], "host string, n double, bad double")).collect()}
    assert out["bad.spam.net"].mean > out["new.spam.net"].mean > 0.5 > out["few.good.net"].mean > out["www.good.net"].mean


# 6 reply trees


def test_reply_trees(spark):
    m = spark.createDataFrame([
        (1, 1, None, "user", "a", 0.0), (1, 2, 1, "assistant", "b", 1.0), (1, 3, 1, "assistant", "c<|im_end|>", 5.0), (1, 4, 3, "user", "d\\<|x\\", None), (None, 1, None, "a\nb\\n", None, None),
        (2, 1, 2, "u", "x", 0.0), (2, 2, 1, "u", "y", 0.0), (2, 3, 2, "u", "z", 0.0), (3, 1, 77, "u", "z", 0.0), (3, 2, 2, "u", "w", 0.0),
    ], "conv_id long, node long, parent long, role string, text string, score double")
    paths = chat_tree.root_to_leaf_paths(m)
    assert rows(paths) == sorted([(None, 1, 1, 0), (1, 2, 2, 0), (1, 2, 1, 1), (1, 4, 4, 0), (1, 4, 3, 1), (1, 4, 1, 2), (3, 1, 1, 0), (3, 2, 2, 0)], key=str)
    best = {(r.conv_id, r.leaf): r for r in chat_tree.read_back(chat_tree.format_paths(m, chat_tree.best_branches(paths, m, 1))).collect()}
    assert set(best) == {(None, 1), (1, 4), (3, 1)}
    assert [(t.role, t.text) for t in best[1, 4].turns] == [("user", "a"), ("assistant", "c<|im_end|>"), ("user", "d\\<|x\\")]
    assert best[1, 4].loss_text == "c<|im_end|>" and best[1, 4].formatted.count("<|im_end|>") == 3
    assert [(t.role, t.text) for t in best[None, 1].turns] == [("a\nb\\n", "")]
    assert chat_tree.root_to_leaf_paths(m.limit(0)).count() == 0


def test_chat_of_long_and_repeated_rows(spark):
    m = spark.createDataFrame([(1, 1, "user", "q" * 200_000), (1, 2, "assistant", "<|" * 50_000), (1, 2, "assistant", "<|" * 50_000)], "conv_id long, turn long, role string, text string").withColumn("leaf", F.lit(0))
    tree = chat_tree.linear_tree(m)
    out = chat_tree.read_back(chat_tree.format_paths(tree, chat_tree.best_branches(chat_tree.root_to_leaf_paths(tree), tree, 1))).collect()
    assert len(out) == 1 and [len(t.text) for t in out[0].turns] == [200_000, 100_000, 100_000] and out[0].loss_text == "<|" * 100_000


def test_long_chains_need_few_rounds(spark):
    n = 70
    m = spark.range(n).select(F.lit(1).alias("conv_id"), "id", F.lit("user").alias("role"), F.col("id").cast("string").alias("text")).withColumnRenamed("id", "turn")
    tree = chat_tree.linear_tree(m)
    out = chat_tree.format_paths(tree, chat_tree.root_to_leaf_paths(tree)).collect()
    assert len(out) == 1 and out[0].formatted == "".join(f"<|im_start|>user\n{i}<|im_end|>\n" for i in range(n))


# 7 Pfair


def test_pfair_lag_stays_below_one_block():
    rng = random.Random(5)
    for _ in range(30):
        shares = {f"s{i}": rng.randint(1, 40) for i in range(rng.randint(1, 9))}
        h, slots = sum(shares.values()), pfair_mix.period_of(shares)
        assert sorted(x for s in slots.values() for x in s) == list(range(h))
        for s, c in shares.items():
            for t in range(h + 1):
                assert abs(sum(x < t for x in slots[s]) * h - c * t) < h


def test_pfair_lag_over_the_whole_schedule():
    cases = [({"a": 9000, "b": 9000, "c": 9000}, {"a": 1.0, "b": 2**0.5, "c": 3**0.5}), ({"a": 20000, "b": 1}, {"a": 1.0, "b": 1e-5}), ({f"s{i}": 1 + i % 7 for i in range(600)}, {f"s{i}": 1 + i**0.5 for i in range(600)})]
    for blocks, weights in cases:
        got, had, ideal, left = list(pfair_mix.schedule(blocks, weights)), dict.fromkeys(blocks, 0), dict.fromkeys(blocks, 0.0), 0.0
        assert [x[2] for x in got] == list(range(sum(blocks.values()))) and len({x[:2] for x in got}) == len(got)
        for s, j, _ in got:
            assert j == had[s]
            had[s], left = had[s] + 1, 1.0
            while left > 1e-9:
                going = [x for x in blocks if ideal[x] < blocks[x] - 1e-9]
                if not going:
                    break
                total = sum(weights[x] for x in going)
                step = min(left, *(total * (blocks[x] - ideal[x]) / weights[x] for x in going))
                for x in going:
                    ideal[x] += step * weights[x] / total
                left -= step
            assert all(abs(had[x] - ideal[x]) < 1 + 1e-6 for x in blocks)


def test_mixing_of_many_sources(spark):
    docs = spark.range(1300).select(F.col("id").alias("doc_id"), (F.col("id") % 600).cast("string").alias("source"))
    out = pfair_mix.pfair_mix(docs, block=2)
    assert out.count() == out.select("slot", "offset").distinct().count() == 1300 and out.agg(F.max("slot")).first()[0] == 699


def test_pipeline_result_keeps_the_mix(spark):
    import corpus_pipeline

    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.when(F.col("id") % 10 == 0, "small").otherwise("large").alias("source"))
    stages = dict(corpus_pipeline.STAGES)
    out = stages["piece_bpe"](spark, stages["pfair_mix"](spark, docs, "").repartition(5), "").orderBy("position").collect()
    share = 100**0.5 / (100**0.5 + 900**0.5)
    small = [r.doc_id % 10 == 0 for r in out]
    assert len({r.position for r in out}) == 1000 and all(abs(sum(small[:n]) - n * share) <= 32 for n in range(300))
    assert 50 < sum(small[:300]) < 100


def test_mixing_keeps_every_row(spark, odd_documents, no_documents):
    out = pfair_mix.pfair_mix(odd_documents, block=2)
    assert out.count() == 12 and out.select("slot", "offset").distinct().count() == 12
    assert pfair_mix.mixed(odd_documents).columns == odd_documents.columns and pfair_mix.mixed(no_documents).count() == 0
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "small").otherwise("large").alias("source"))
    first = [r.source for r in pfair_mix.mixed(docs, weights={"small": 1, "large": 1}, block=5).limit(200).collect()]
    assert all(abs(first[:n].count("small") - n / 2) <= 5 for n in range(1, 190))
    again = [r.doc_id for r in pfair_mix.mixed(docs.repartition(7), weights={"small": 1, "large": 1}, block=5).collect()]
    assert again == [r.doc_id for r in pfair_mix.mixed(docs, weights={"small": 1, "large": 1}, block=5).collect()]
    weighted = pfair_mix.pfair_mix(docs, weights={"small": 1})
    assert weighted.count() == 1000


# 8 packing


def test_best_fit_decreasing_is_the_naive_one():
    rng = np.random.default_rng(0)
    for _ in range(100):
        length = int(rng.integers(5, 40))
        sizes = rng.integers(1, length + 1, size=int(rng.integers(0, 60)))
        free, bins = [], 0
        for i in np.argsort(-sizes, kind="stable"):
            room = [f for f in free if f >= sizes[i]]
            if room:
                free[free.index(min(room))] -= sizes[i]
            else:
                free.append(length - sizes[i])
                bins += 1
        mine = pack.best_fit_decreasing(sizes, length)
        assert len(mine) == bins and sorted(x for b in mine for x in b) == list(range(len(sizes))) and all(sizes[b].sum() <= length for b in mine)


def test_packing_is_lossless(odd_documents, no_documents):
    out = pack.pack_documents(odd_documents, length=64).collect()
    parts = {}
    for r in out:
        ids, positions = np.frombuffer(r.input_ids, np.int32), np.frombuffer(r.position_ids, np.int32)
        assert len(ids) == len(positions) == 64 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_ids <= 64
        for d, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            assert positions[a:b].tolist() == list(range(b - a))
            parts.setdefault(d, []).append((start, ids[a:b].tolist()))
    tokenizer = pack.tokenizer(pack.default_ranks())
    for r in odd_documents.select("doc_id", "text").distinct().collect():
        got = sorted(parts.get(r.doc_id, []))
        want = tokenizer.encode_ordinary(r.text or "")
        copies = 2 if r.doc_id == 7 else 1
        assert [x for s, p in got for x in p] == [x for at in range(0, len(want), 64) for _ in range(copies) for x in want[at : at + 64]]
    assert pack.pack_documents(no_documents).count() == 0 and len({r.pack_id for r in out}) == len(out)


# 9 PartEnum


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(1)
    for percent in (80, 85):
        hits = 0
        for t in range(700):
            base = np.unique(rng.integers(0, 1 << 63, size=int(rng.integers(1, 300 if t % 2 else 30))).astype(np.uint64))
            d = int(rng.integers(0, max(1, int(0.12 * len(base))) + 1))
            other = np.unique(np.concatenate([base[rng.permutation(len(base))[d:]], rng.integers(0, 1 << 63, size=int(rng.integers(0, d + 2))).astype(np.uint64)]))
            both, either = len(np.intersect1d(base, other)), len(np.union1d(base, other))
            if len(other) and 100 * both >= percent * either and both < either:
                hits += 1
                assert len(np.intersect1d(partenum.signatures(base, percent), partenum.signatures(other, percent)))
            assert partenum.most_common(*partenum.folded([partenum.sketch(s) for s in (base, other)])) >= both
        assert hits > 150


def test_signatures_combine_sub_parts():
    """One shingle more is in one sub-part of one part: it changes all signatures of that part but the one that leaves it out."""
    rng = np.random.default_rng(4)
    for size in (30, 60, 100, 250, 300, 1000, 5000):
        base = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        n1, n2 = partenum.parts_of((partenum.band_starts(85)[int(np.searchsorted(partenum.band_starts(85), size, "right"))] - 1) * 15 // 85)
        assert n2 > 2
        more = np.append(base, np.uint64(1 << 63))
        a, b = (partenum.signatures(s, 85) for s in (base, more))
        assert len(a) <= 2 * n1 * n2 and 1 <= len(np.setdiff1d(a, b)) <= len(a) - len(np.intersect1d(a, b)) and len(np.intersect1d(a, b))


def test_long_sets_share_a_signature():
    rng = np.random.default_rng(6)
    for size in (300, 1000, 5000):
        for _ in range(20):
            base = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
            most = int(0.15 * len(base))  # as many shingles as may go at 85 %
            other = base[np.sort(rng.permutation(len(base))[most:])]
            assert 100 * len(other) >= 85 * len(base) and len(np.intersect1d(partenum.signatures(base, 85), partenum.signatures(other, 85)))


def test_other_sizes_cost_no_rows(spark):
    """Members meet blocks of their own size and its neighbours only: of sizes spread as those of texts are, rows grow far less than by the square."""
    held = F.lit(b"").alias("held")
    counts = {}
    for m in (10_000, 40_000):
        rows = spark.range(m).select(F.lit(0).cast("long").alias("leader"), F.col("id").alias("cls"), F.floor(F.pow(F.lit(10.0), 1.5 + 2 * (F.col("id") % 997) / 997)).cast("int").alias("n"), F.col("id").alias("component"), held)
        counts[m] = partenum._dealt(rows, 85, partenum.OF_SKETCHES).count()
    assert counts[40_000] < 6 * counts[10_000] and counts[40_000] < 4 * 40_000
    rows = spark.createDataFrame([(0, i, n, i, b"") for i, n in enumerate([1, 85, 100, 117, 118, 1000] * 9)], "leader long, cls long, n int, component long, held binary")
    dealt = partenum._dealt(rows.union(rows.withColumn("leader", F.lit(1).cast("long")).where("cls < 9")), 85, 1)
    assert dealt.count() == 54 + 9 and dealt.agg(F.max("hi")).first()[0] == 0


def test_full_bins_of_sketches_leave_room():
    full = np.full(partenum.LEAST_BINS, 65535, np.uint16)
    assert partenum.most_common(full, full) > 1 << 30
    rng = np.random.default_rng(0)
    long = np.unique(rng.integers(0, 1 << 63, 4000).astype(np.uint64))
    a, b = partenum.folded([partenum.sketch(long), partenum.sketch(long[:900])])
    assert len(a) == len(b) == 256 and a.sum() == 4000 and b.sum() == 900 == partenum.most_common(a, b)


def naive_components(texts, words_each, percent):
    sets = {}
    for i, t in texts.items():
        w = blank_words(t)
        sets[i] = {tuple(w[j : j + words_each]) for j in range(len(w) - words_each + 1)} or ({tuple(w)} if w else set())
    comp = {i: i for i in texts}
    for a, b in itertools.combinations(sorted(texts), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and comp[a] != comp[b]:
            low, high = sorted((comp[a], comp[b]))
            comp = {i: low if c == high else c for i, c in comp.items()}
    return {i: (len(sets[i]), comp[i]) for i in texts}


def test_jaccard_join_is_brute_force(spark):
    rng = random.Random(9)
    texts = {}
    for i in range(150):
        if i % 3 == 0 or i < 3:
            texts[i] = sentence(i, rng.randint(0, 120))
        else:
            w = texts[rng.randrange(i)].split()
            for _ in range(rng.randint(0, 4)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice("abcdefgh")
            texts[i] = " ".join(w) if rng.random() < 0.9 else " ".join(w[: len(w) // 2])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for words_each, percent in ((4, 85), (2, 80)):
        out = {r.doc_id: (r.n_shingles, r.component_id) for r in partenum.jaccard_components(docs, words_each, percent).collect()}
        assert out == naive_components(texts, words_each, percent)


def test_jaccard_join_of_long_texts_is_brute_force(spark):
    """Texts of some 300 to 1200 shingles, with changes on both sides of the threshold, passages that many share, and chains that one leader does not settle."""
    rng = random.Random(21)
    passage, texts = sentence(999, 250), {}
    for i in range(60):
        if i % 6 == 0:
            texts[i] = sentence(i, rng.randint(300, 1200)) + (" " + passage if i % 4 == 0 else "")
        else:
            w = texts[i - 1 if i % 2 else i - i % 6].split()
            for _ in range(rng.randint(0, len(w) // 20)):
                w[rng.randrange(len(w))] = rng.choice("abcdefgh")
            texts[i] = " ".join(w)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in partenum.jaccard_components(docs, 4, 85).collect()}
    want = naive_components(texts, 4, 85)
    assert out == want and 10 < len({c for _, c in want.values()}) < 55 and min(n for n, _ in want.values()) > 277


def test_jaccard_join_of_odd_rows(odd_documents, no_documents):
    out = rows(partenum.jaccard_components(odd_documents), "doc_id", "n_shingles", "component_id")
    by = {d: (n, c) for d, n, c in out}
    assert len(out) == 12 and by[3] == (0, 3) and by[8] == (0, 8) and by[2] == (1, 1) and by[6][1] == 5 and by[None][1] is None
    kept = partenum.keep_one_of_each(odd_documents)
    assert kept.columns == odd_documents.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 7, 7, 8, 9, 10]
    assert partenum.jaccard_components(no_documents).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 90), (90, 100), (5, 5), (None, 3), (50, 60), (50, 61), (50, 62)], "a long, b long")
    out = dict(rows(components.connected_components(links, "a", "b")))
    assert {out[i] for i in range(31)} == {0} and out[100] == out[90] == 90 and out[62] == 50 and None not in out
    assert components.connected_components(links.limit(0), "a", "b").count() == 0


# 10 SentencePiece


def test_piece_bpe_is_the_library(odd_documents, no_documents):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_bpe.default_model())
    own = piece_bpe.load(piece_bpe.default_model())
    rng = random.Random(1)
    parts = ["a", "b", "th", "e", " ", "  ", "    ", "\u2581", "é", "日", "\n", "\t", "🎉", "<s>", "<0x41>", "1", "A", "ing", "\x00", "~", "=", "-", "the ", "ö", "ß", "."]
    texts = ["", " " * 70, "x" * 3000] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    for t in texts:
        ids = np.frombuffer(own.encode(t), np.int32)
        want = library.encode(t)
        assert ids.tolist() == want and own.decode(ids) == library.decode(want)
    broken = [own.byte[0xC3], own.byte[0x41], own.byte[0xE2], own.byte[0x82]]
    assert own.decode(np.array(broken)) == "\ufffdA\ufffd\ufffd"
    for r, d in zip(piece_bpe.encode_documents(odd_documents).collect(), odd_documents.collect(), strict=True):
        assert list(r.ids) == library.encode(d.text or "") and r.decoded == library.decode(list(r.ids))
    assert piece_bpe.encode_documents(no_documents).count() == 0


def test_repeated_ids_with_different_texts(spark):
    """Ids may repeat: classes go by their sets, so no link of either text is lost."""
    a, b = sentence(1, 60), sentence(2, 60)
    docs = spark.createDataFrame([(1, a), (1, b), (2, a + " more"), (3, b + " more"), (None, b + " else"), (None, sentence(3, 60)), (9, sentence(4, 60))], "doc_id long, text string")
    out = rows(partenum.jaccard_components(docs), "doc_id", "component_id")
    assert out == sorted([(1, 1), (1, 1), (2, 1), (3, 1), (None, 1), (None, None), (9, 9)], key=str)


def test_groups_are_compared_in_blocks(spark, monkeypatch):
    """A chain and a crowd that no leader settles, in blocks of a few members: the links found join what brute force joins."""
    monkeypatch.setattr(partenum, "BLOCK", 4)
    monkeypatch.setattr(partenum, "OF_SKETCHES", 1)
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 1 << 63, 60).astype(np.uint64))
    sets = {i: np.unique(np.concatenate([base[: int(rng.integers(40, 60))], rng.integers(0, 1 << 63, int(rng.integers(1, 9))).astype(np.uint64)])) for i in range(40)}
    for exact in (False, True):
        held = [(0, i, len(s), i // 3, s.view(np.int64).tolist() if exact else bytearray(partenum.sketch(s))) for i, s in sets.items()]
        df = spark.createDataFrame(held, "leader long, cls long, n int, component long, held " + ("array<long>" if exact else "binary")).repartition(3)
        got = partenum._compared(df, 80, exact).collect()
        joined = {i: i // 3 for i in sets}
        linked = set()
        for a, b in itertools.combinations(sets, 2):
            both = len(np.intersect1d(sets[a], sets[b]))
            if a // 3 != b // 3 and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                linked |= {a, b}
                low, high = sorted((joined[a], joined[b]))
                joined = {i: low if c == high else c for i, c in joined.items()}
        if exact:
            own = {i: i // 3 for i in sets}
            for r in got:
                low, high = sorted((own[r.a], own[r.b]))
                own = {i: low if c == high else c for i, c in own.items()}
            assert {i: min(j for j in own if own[j] == own[i]) for i in own} == {i: min(j for j in joined if joined[j] == joined[i]) for i in joined} and linked
        else:
            assert linked <= {r.b for r in got}
