"""Each operator against a brute-force version on small tables."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioforge.llm import apportion_mix, chosen_path, chunk_dedup, flac_media, lang_fusion, pfor_tokens, pii_crf, residual_packing, url_templates, zstd_toxicity
from folioforge.llm import queries as llm_queries
from folioforge.llm.common import FastEncoder

from . import data

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def collect(df):
    return [r.asDict() for r in df.collect()]


# --- 1 ---


def test_encoder_equals_tokenizer(tokenizer):
    import pyarrow as pa

    rng = random.Random(2)
    parts = ["a", " ", "  ", "\n", " \n", "\t", "<|endoftext|>", "é", "1", "'s", "ß", "\r\n", " ", " ", "日本", ".", " .", "\x1c", "×", "ab.", "b,", "don't"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(4000)] + [None]
    enc = FastEncoder(PATH, cached=500)
    ids, at = enc.encode_column(pa.array(texts))
    for t, a, b in zip(texts, at[:-1], at[1:], strict=True):
        assert ids[a:b].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("percentile", [1.0, 50.0, 90.0, 100.0])
def test_pfor_round_trip(percentile):
    rng = np.random.default_rng(3)
    for n in (0, 1, 255, 256, 257, 5000):
        ids = np.where(rng.random(n) < 0.1, rng.integers(0, 2**32 - 1, n), rng.integers(0, 500, n)).astype(np.uint32)
        starts = np.array([0, n // 3, n])
        f = pfor_tokens.TokenFile(pfor_tokens.pack(ids, np.array([4, 9]), starts, 4, percentile=percentile))
        assert (f.read(0, n) == ids).all() and f.starts.tolist() == starts.tolist() and f.doc_ids.tolist() == [4, 9]
        for _ in range(20):
            a, b = sorted(rng.integers(0, n + 1, 2))
            assert (f.read(a, b) == ids[a:b]).all()


def test_pfor_refuses_other_bytes():
    with pytest.raises(ValueError):
        pfor_tokens.TokenFile(b"XXXX" + bytes(60))


def test_token_files(spark, tokenizer):
    files = pfor_tokens.write_files(data.docs(spark), PATH, file_ids=3000)
    assert files.count() > 4
    got = collect(pfor_tokens.read_files(files).orderBy("start"))
    at = 0
    for row, (doc, text, *_) in zip(got, sorted(data.rows(), key=lambda r: (r[0], r[1] or "")), strict=True):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        assert (row["doc_id"], row["start"], row["n_tokens"], row["ids_crc32"]) == (doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_token_files_of_one_hot_id(spark, tokenizer, tmp_path):
    """Rows without an id, and those of one id, spread over the shards; the saved files hold the same ids."""
    rows = [(None, f"text {i} of none") for i in range(200)] + [(5, f"text {i} of five") for i in range(200)] + [(i, "x") for i in range(20)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("draw", F.lit("clash")).withColumn("shard", F.lit(1))
    files = pfor_tokens.write_files(d, PATH, shards=6).cache()
    got = collect(pfor_tokens.read_files(files).orderBy("start"))
    crc = lambda t: zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes())
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in got) == Counter((i, crc(t)) for i, t in rows)
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert ids == sorted(ids) and [r["start"] for r in got] == [sum(r["n_tokens"] for r in got[:i]) for i in range(len(got))]
    assert len({r["shard"] for r in got if r["doc_id"] is None}) > 1 and len({r["shard"] for r in got if r["doc_id"] == 5}) > 1
    named = sorted(collect(pfor_tokens.saved(files, f"file://{tmp_path}/out")), key=lambda r: r["name"])
    read = [pfor_tokens.TokenFile((tmp_path / "out" / r["name"]).read_bytes()) for r in named]
    assert sum(f.n for f in read) == sum(r["n_tokens"] for r in got) and len(list((tmp_path / "out").iterdir())) == len(named)
    assert sum((list(f.doc_ids) for f in read), []) == [-(1 << 63) if r["doc_id"] is None else r["doc_id"] for r in got]


# --- 2 ---


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_exact_dedup(spark, digest_bytes):
    """With digests of one byte most chunks collide, and the result is the same."""
    got = collect(chunk_dedup.groups(data.docs(spark), digest_bytes=digest_bytes))
    by = defaultdict(list)
    for r in data.rows():
        by[(r[1] or "").translate(LOWER)].append(r[0])
    text_of = {r[0]: (r[1] or "").translate(LOWER) for r in data.rows()}
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in data.rows())
    for r in got:
        group = by[text_of[r["doc_id"]]]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(group), len(group), r["doc_id"] == max(group))
        assert r["text_sha256"] == hashlib.sha256(text_of[r["doc_id"]].encode()).hexdigest()


def test_chunks_join_to_the_text_and_move_with_it():
    rng = random.Random(5)
    body = bytes(rng.randrange(97, 123) for _ in range(100_000))
    for t in (b"", b"a", body, b"a" * 100_000):
        assert b"".join(chunk_dedup.chunks(t)) == t and max(map(len, chunk_dedup.chunks(t))) <= chunk_dedup.MAX_CHUNK
    one, two = set(chunk_dedup.chunks(body)), set(chunk_dedup.chunks(b"shifted by this " + body))
    assert len(one & two) >= len(one) - 3


def test_deduplicate_keeps_columns(spark):
    d = data.docs(spark)
    out = chunk_dedup.deduplicate(d)
    assert out.columns == d.columns
    assert {r.doc_id for r in out.collect()} == {r["doc_id"] for r in collect(chunk_dedup.groups(d)) if r["kept"]}


# --- 3 ---


def _urls(spark):
    rng = random.Random(8)
    urls = [f"https://{'www.' if i % 2 else ''}h{i % 3}.example.org/{rng.choice(['good', 'bad'])}/{rng.choice('abcdefgh')}/{i}.html?x=1" for i in range(600)]
    urls += [None, "", "no scheme", "HTTP://EXAMPLE.NET/en/1", "http://a.net", "http://a.net/", "http://a.net/x?y#z", "http://b.example.com/de/q", "http://x.org/fr/", "http://xorg/fr/", "http://n.example.net/en", "ftp://é.org/fr/Ä", "http://badnet/x", "http://a.net#/en/"]
    return urls, spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")


def _rule(host, path):
    best = None
    for says, h, p in url_templates.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, says)
    return best


def test_url_rules_and_templates(spark):
    urls, pages = _urls(spark)
    labels = spark.createDataFrame([(i, int("/bad/" in (u or ""))) for i, u in enumerate(urls) if (i // 3) % 3] + [(3, 0), (10**9, 1)], "page_id long, bad int")
    got = {r["page_id"]: r for r in collect(url_templates.judged(pages, labels))}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        m = re.search(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m.group(1).translate(LOWER), m.group(2)) if m else ("", "")
        assert (got[i]["host"], got[i]["path"]) == (host, path)
        rule = _rule(host, path)
        assert got[i]["rule"] == (rule and rule[0])
        want = rule[1] if rule else ("block" if got[i]["purity"] > got[i]["limit"] else "allow")
        assert got[i]["verdict"] == want
        if i < 600:  # the branch that tells stays literal, the others are wildcards
            branch = path.split("/")[1]
            assert got[i]["template"] == f"/{branch}/*/*" and got[i]["verdict"] == ("block" if branch == "bad" else "allow")


def _tree(pages, labels):
    """Brute force of templates, purities and verdicts of pages without a rule: ``(host, path segments)`` by id."""
    bad = {}
    for i, b in labels:
        if b is not None:
            bad[i] = max(b, bad.get(i, 0))
    skeletons = {i: (h, tuple("*" if re.search("[0-9]", s) else s for s in p.split("/") if s)) for i, (h, p) in pages}
    template = {}

    def grow(ids, depth, prefix):
        """Templates of the pages below one node."""
        ended = [i for i in ids if len(skeletons[i][1]) == depth]
        for i in ended:
            template[i] = prefix
        ids = [i for i in ids if len(skeletons[i][1]) > depth]
        seen = {skeletons[i] for i in ids}
        if depth and len(ids) < url_templates.LEAST_PAGES:
            for i in ids:
                template[i] = prefix + "/*" * (len(skeletons[i][1]) - depth)
            return
        if depth and len(seen) == 1:
            for i in ids:
                template[i] = prefix + "".join(f"/{s}" for s in skeletons[i][1][depth:])
            return
        by = defaultdict(list)
        for i in ids:
            by[skeletons[i][1][depth]].append(i)
        merged = defaultdict(list)
        for segment, mine in by.items():
            n, b = sum(i in bad for i in mine), sum(bad.get(i, 0) for i in mine)
            rest_n, rest_b = sum(i in bad for i in ids) - n, sum(bad.get(i, 0) for i in ids) - b
            pooled, inverse = (b + rest_b) / max(1, n + rest_n), 1 / max(1, n) + 1 / max(1, rest_n)
            spread = (pooled * (1 - pooled) * inverse) ** 0.5
            differs = n and rest_n and spread > 0 and abs(b / max(1, n) - rest_b / max(1, rest_n)) - inverse / 2 > 1.96 * spread
            literal = segment != "*" and len(mine) >= url_templates.LEAST_PAGES and (len(mine) == len(ids) or differs)
            merged[segment if literal else "*"] += mine
        for segment, mine in merged.items():
            grow(mine, depth + 1, f"{prefix}/{segment}")

    hosts = defaultdict(list)
    for i, (h, _) in pages:
        hosts[h].append(i)
    known = [i for i in skeletons if i in bad]
    base = (sum(bad[i] for i in known) + 1) / (len(known) + 2)
    out = {}
    for ids in hosts.values():
        grow(ids, 0, "")
        n, b = sum(i in bad for i in ids), sum(bad.get(i, 0) for i in ids)
        host_share = (b + 20 * base) / (n + 20)
        groups = defaultdict(list)
        for i in ids:
            groups[template[i]].append(i)
        for t, mine in groups.items():
            n, b = sum(i in bad for i in mine), sum(bad.get(i, 0) for i in mine)
            purity = (b + 20 * host_share) / (n + 20)
            limit = min(base, 0.5) + 1.2816 * (purity * (1 - purity) / (n + 20)) ** 0.5 if not n or b / n > base else 1.0
            out |= dict.fromkeys(mine, (t, round(purity, 9), "block" if purity > limit else "allow"))
    return out


def test_url_tree_by_brute_force(spark):
    """Random sites, among them repeated rows, a null id's page and columns of clashing names."""
    rng = random.Random(81)
    urls = []
    for i in range(3000):
        host = rng.choice(["one", "two", "two", "two", "three"]) + ".info"
        path = "".join(f"/{rng.choice(['a', 'b', 'c', 'long-named-section-of-the-site', str(rng.randrange(99))])}" for _ in range(rng.randint(0, 5)))
        urls.append((i, f"http://{host}{path}"))
    share = lambda u: 0.85 if "/b" in u and "two" in u else 0.5 if u.endswith("/c") else 0.1
    labels = [(i, int(rng.random() < share(u))) for i, u in urls if rng.random() < 0.6]
    pages = [(i, (re.search("//([^/]*)", u).group(1), re.search("//[^/]*(.*)", u).group(1))) for i, u in urls]
    want = _tree(pages, labels)
    d = spark.createDataFrame([(i, u, "x", 1.0, "y") for i, u in urls], "page_id long, url string, host string, bad double, skeleton string")
    got = collect(url_templates.judged(d, spark.createDataFrame([(*r, "z") for r in labels], "page_id long, bad int, host string")))
    assert {r["page_id"]: (r["template"], round(r["purity"], 9), r["verdict"]) for r in got} == want
    assert {v for _, _, v in want.values()} == {"allow", "block"} and len({t for t, _, _ in want.values()}) > 10
    twice = spark.createDataFrame([(None, "http://a.info/b"), (1, "http://a.info/b"), (1, "http://a.info/b"), (None, None)], "page_id long, url string")
    assert Counter((r["page_id"], r["host"], r["verdict"]) for r in collect(url_templates.judged(twice, spark.createDataFrame([], "page_id long, bad int")))) == Counter({(None, "a.info", "allow"): 1, (1, "a.info", "allow"): 2, (None, "", "allow"): 1})


def test_url_query_judges_by_its_method(spark):
    """On the given pages: the number that ends an address is its document, of the language that the path
    names, and pages without a rule get both verdicts."""
    sf = "/root/testdata/sf0.1"
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = llm_queries.op3_url_filter(spark, sf).collect()
    assert all(docs[int(m.group(2))] == m.group(1) for r in got if (m := re.search(r"^/([a-z]+)/([0-9]+)", r.path)))
    assert {r.verdict for r in got if r.rule is None} == {"allow", "block"}
    assert all((r.verdict == "block") == (r.purity > r.limit) for r in got if r.rule is None)


def test_url_branches_of_any_share_and_depth(spark):
    """A small bad section of a large host, and bad branches below a deep path, are told apart."""
    deep = "/".join("abcdefgh")
    urls = [f"http://big.org/s{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}/{i}" for i in range(6000)]
    urls += [f"http://big.org/tiny/{i}" for i in range(60)]
    urls += [f"http://deep.org/{deep}/{'worse' if i % 2 else 'fine'}/{i}" for i in range(200)]
    urls += [f"http://long.org/{'x/' * 300}{i}" for i in range(8)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, int("/tiny/" in u or "/worse/" in u)) for i, u in enumerate(urls)], "page_id long, bad int")
    got = {r["page_id"]: r for r in collect(url_templates.judged(pages, labels))}
    for i, u in enumerate(urls):
        if "/tiny/" in u:
            assert (got[i]["template"], got[i]["verdict"]) == ("/tiny/*", "block")
        elif "deep" in u:
            branch = "worse" if "/worse/" in u else "fine"
            assert (got[i]["template"], got[i]["verdict"]) == (f"/{deep}/{branch}/*", "block" if branch == "worse" else "allow")
        elif "long" in u:
            assert got[i]["template"] == "/x" * 300 + "/*"
        else:
            assert got[i]["verdict"] == "allow"


def test_url_filter_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_templates.judged(pages, spark.createDataFrame([], "page_id long, bad int")).count() == 0


# --- 4 ---


def _sets(rows):
    out = {}
    for doc, text, *_ in rows:
        w = WORD.findall((text or "").translate(LOWER))
        out[doc] = frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1))))
    return out


def _components(sets):
    parent = {d: d for d in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(d for d in sets if sets[d])
    for i, a in enumerate(ids):
        for b in ids[:i]:
            same = len(sets[a] & sets[b])
            if 100 * same >= 75 * (len(sets[a]) + len(sets[b]) - same):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


@pytest.mark.parametrize(("node", "cluster", "depth"), [(1000, 1 << 21, 6), (2, 1500, 3)])
def test_near_dedup(spark, node, cluster, depth):
    """Small nodes and clusters are cut to the full depth and dealt out in blocks; the components are the same."""
    got = collect(chosen_path.components(data.docs(spark), node=node, cluster=cluster, depth=depth))
    sets = _sets(data.rows())
    want = _components(sets)
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in data.rows())
    assert len(set(want.values())) < len(want) - 5
    for r in got:
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"]), r


def test_near_dedup_of_one_large_group(spark):
    """A group larger than a node: copies with single words changed, one chain of links."""
    rng = random.Random(9)
    base = data.words(rng, 80).split(" ")
    rows = []
    for i in range(150):
        base = list(base)
        base[rng.randrange(80)] = f"w{i}"
        rows.append((i, " ".join(base), None, None, None, None, None, None, None))
    got = {r["doc_id"]: r["component_id"] for r in collect(chosen_path.components(spark.createDataFrame(rows, data.SCHEMA), node=40, cluster=20_000, depth=3))}
    assert got == _components(_sets(rows))


@pytest.mark.parametrize("loose", [False, True])
def test_large_groups_in_blocks(spark, loose):
    """A group of several kinds that share one node: links inside blocks, by representatives and by the rest."""
    rng = random.Random(71)
    kinds = [data.words(rng, 60).split(" ") for _ in range(60 if loose else 6)]
    rows = []
    for i in range(500):
        w = list(kinds[min(int(rng.expovariate(0.05 if loose else 3.0)), len(kinds) - 1)])
        w[rng.randrange(60)] = f"w{i}"
        rows.append((i, 7, " ".join(w)))
    want = _components(_sets([(i, t) for i, _, t in rows]))
    d = spark.createDataFrame(rows, "id long, key long, body string").withColumn("weight", F.lit(1).cast("long"))
    find = chosen_path.by_sets(5, 75, 100)
    sizes = spark.createDataFrame([(7, 500, 13)], "key long, n long, blocks long")
    links, rest = chosen_path.in_blocks(d, sizes, 40, find)
    left = chosen_path.blocks_of(rest, 40)
    assert (left.first().rest_blocks > 1) == loose
    links = links.unionByName(chosen_path.stars(chosen_path.with_rest(d, sizes, rest, left), find))
    got = {r.id: r.root for r in chosen_path.connected(links).collect()}
    assert {i: got.get(i, i) for i in range(500)} == want


def test_near_dedup_recurses_and_finds_all_links(spark):
    """Thousands of texts that share passages: nodes larger than ``NODE`` are cut, at the production parameters, and
    the components are those of an exact join over an inverted index of shingles."""
    rng = random.Random(73)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(3000)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, bases = say(12), [say(40) for _ in range(900)]
    rows = []
    for i in range(4500):
        w = list(rng.choice(bases)) if i % 3 else say(40)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, " ".join(passage + w)))
    sets = _sets(rows)
    index = defaultdict(list)
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        return a

    for i, _ in rows:
        shared = Counter(j for s in sets[i] for j in index[s])
        for j, same in shared.items():
            if 100 * same >= 75 * (len(sets[i]) + len(sets[j]) - same):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for s in sets[i]:
            index[s].append(i)
    levels = []
    plain, chosen_path.descended = chosen_path.descended, lambda *a: levels.append(1) or plain(*a)
    try:
        got = {r["doc_id"]: r["component_id"] for r in collect(chosen_path.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)))}
    finally:
        chosen_path.descended = plain
    assert len(levels) > 1
    assert got == {i: find(i) for i, _ in rows}


def test_near_dedup_of_repeated_ids(spark):
    """Of rows that repeat an id the least text counts, whatever the partitioning; null ids stay by themselves."""
    rng = random.Random(74)
    one, two = data.words(rng, 30), data.words(rng, 30)
    rows = [(1, max(one, two)), (1, min(one, two)), (2, min(one, two)), (3, max(one, two)), (None, one), (None, one), (4, None), (4, "")]
    for n in (1, 4):
        got = collect(chosen_path.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(n)))
        assert Counter((r["doc_id"], r["component_id"], r["kept"]) for r in got) == Counter({(1, 1, True): 2, (2, 1, False): 1, (3, 3, True): 1, (None, None, True): 2, (4, 4, True): 2})


def test_signature_estimates_similarity():
    a = chosen_path.mix(np.arange(1, 1001, dtype=np.uint64))
    h = np.concatenate((np.sort(a[:900]), np.sort(a[100:])))
    s = chosen_path.signatures(h, np.array([0, 900, 1800]))
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.15


# --- 5 ---


def test_language_fusion(spark):
    rng = random.Random(4)
    en, fr = ("the", "and", "with", "that"), ("les", "des", "avec", "pour")
    rows = [(i, " ".join(rng.choice(fr if i % 2 else en) for _ in range(30)), "fr" if i % 2 else "en", f"h{i % 2}", None, None, None, None, None) for i in range(80)]
    rows += [(100, None, None, None, *[None] * 5), (101, "", "fr", "h1", *[None] * 5), (102, "zz", None, "h0", *[None] * 5), (103, None, "xx", "new", *[None] * 5)]
    d = spark.createDataFrame(rows, data.SCHEMA)
    model = lang_fusion.train(d, "lang", "doc_id", "text")
    assert model[0] == ["en", "fr"]
    got = {r["doc_id"]: r for r in collect(lang_fusion.fused(d, "doc_id", "text", model, declared=F.col("lang"), host=F.col("source")))}
    assert len(got) == len(rows)
    for i in range(80):
        assert got[i]["lang_pred"] == ("fr" if i % 2 else "en") and got[i]["accepted"]
    assert got[101]["lang_pred"] == "fr"  # by what it declares and by its host
    assert got[102]["lang_pred"] == "en"  # by its host
    kept = lang_fusion.accepted(d, "doc_id", "text", model, declared=F.col("lang"), host=F.col("source"))
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {k for k, v in got.items() if v["accepted"]}


def test_every_labelled_language_has_a_model(spark):
    """Many languages, one of a single text, and one of long texts only."""
    rng = random.Random(41)
    names = [f"l{i:02}" for i in range(70)]
    vocabulary = {n: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(8)] for n in [*names, "long", "one"]}
    say = lambda n, k: " ".join(rng.choice(vocabulary[n]) for _ in range(k))
    rows = [(say(n, 40), n) for n in names for _ in range(6)] + [(say("long", 4000), "long") for _ in range(6)] + [(say("one", 200), "one")]
    d = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(rows)], "doc_id long, text string, lang string")
    model = lang_fusion.train(d, "lang", "doc_id", "text")
    assert model[0] == sorted([*names, "long", "one"])
    got = {r["doc_id"]: r for r in collect(lang_fusion.fused(d, "doc_id", "text", model, declared=F.col("lang")))}
    assert all(got[i]["lang_pred"] == n and got[i]["accepted"] for i, (_, n) in enumerate(rows))


def test_thousands_of_declared_values_share_a_model(spark):
    """A column of declared languages full of noise bounds the model; the languages that texts are in stay apart."""
    rng = random.Random(6)
    a, b = (["".join(rng.choice(letters) for _ in range(5)) for _ in range(12)] for letters in ("abcdef", "uvwxyz"))
    say = lambda words: " ".join(rng.choice(words) for _ in range(12))
    rows = [(say(a), "aa") for _ in range(300)] + [(say(b), "bb") for _ in range(300)] + [(say(rng.choice([a, b])), f"noise-{i}") for i in range(10_000)]
    d = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(rows)], "doc_id long, text string, lang string").repartition(4)
    names, table = lang_fusion.train(d, "lang", "doc_id", "text", sample=100, most=5)
    assert len(names) == 6 and {"aa", "bb", lang_fusion.OTHERS} <= set(names) and table.shape == (7, lang_fusion.BUCKETS)
    got = {r["doc_id"]: r for r in collect(lang_fusion.fused(d.where("doc_id < 600"), "doc_id", "text", (names, table), declared=F.col("lang")))}
    assert all(got[i]["lang_pred"] == rows[i][1] for i in range(600))
    assert lang_fusion.train(d.limit(0), "lang", "doc_id", "text")[0] == []


def test_no_row_is_rejected_for_a_language_without_model(spark):
    d = spark.createDataFrame([(i, "the and with that " * 8, "en") for i in range(20)], "doc_id long, text string, lang string")
    model = lang_fusion.train(d, "lang", "doc_id", "text")
    new = spark.createDataFrame([(1, "qzx vkj wqp " * 20, "new"), (2, "qzx vkj wqp " * 20, None), (3, "qzx vkj wqp " * 20, "en")], "doc_id long, text string, lang string")
    judge = lambda wanted: {r["doc_id"]: r["accepted"] for r in collect(lang_fusion.fused(new, "doc_id", "text", model, declared=F.col("lang"), wanted=wanted))}
    assert judge(None)[1] and not judge(None)[2] and not judge(("en",))[1] and judge(("new",))[1]


def _fused(rows, model, declared=True, suffix=False, host=True):
    """Brute force of the fusion: ``(text, declared, suffix, host)`` to ``(language, confidence, accepted)``."""
    names, table = model
    n = len(names) + 1
    base = np.array([0.99 / len(names)] * len(names) + [0.01])
    norm = lambda v: np.exp(v - v.max()) / np.exp(v - v.max()).sum()
    loglik = []
    for text, *_ in rows:
        raw = (text or "").encode().lower()
        grams = [lang_fusion._trigrams(np.frombuffer(raw[i : i + 3], np.uint8))[0] for i in range(len(raw) - 2)]
        total = sum((table[:, g].astype(np.float64) for g in grams), np.zeros(n))
        loglik.append(total * min(1.0, lang_fusion.EVIDENCE / max(1, sum(g > 0 for g in grams))))
    guess = [norm(v + np.log(base)) for v in loglik]
    mass = np.sum(guess, 0)
    everyone = (mass + base) / (mass.sum() + 1)
    share = lambda ids, i, towards, k: (sum((guess[j] for j in ids if j != i), np.zeros(n)) + k * towards) / (sum(guess[j].sum() for j in ids if j != i) + k)
    groups = [defaultdict(list) for _ in range(3)]
    for i, (_, d, s, h) in enumerate(rows):
        for g, key in zip(groups, (d, s, (h, s) if h is not None else None), strict=True):
            if key is not None:
                g[key].append(i)
    out = []
    for i, (_, d, s, h) in enumerate(rows):
        start = everyone
        if suffix and s is not None:
            start = share(groups[1][s], i, start, lang_fusion.SUFFIX_STRENGTH)
        if host and h is not None:
            start = share(groups[2][h, s], i, start, lang_fusion.HOST_STRENGTH)
        total = loglik[i] + np.log(start)
        if declared and d is not None:
            total = total + np.log(share(groups[0][d], i, everyone, lang_fusion.FIELD_STRENGTH) / everyone)
        p = norm(total)
        k = int(p.argmax())
        out.append(([*names, "und"][k], round(float(p[k]), 6), k < len(names) and p[k] >= 0.5 or (declared and d is not None and d not in names)))
    return out


@pytest.mark.parametrize("suffix", [False, True])
def test_language_fusion_by_brute_force(spark, suffix):
    """Rows with and without each evidence, of null ids, repeated, and with columns of clashing names."""
    rng = random.Random(51)
    voices = {"en": "the and with that have this from".split(), "fr": "les des avec pour dans que une".split(), "xx": "qzxw vkjq wpgk zzhq xkvd".split()}
    rows = []
    for i in range(240):
        voice = rng.choice(["en", "en", "fr", "xx"])
        text = rng.choice([None, "", "12 34", *[" ".join(rng.choice(voices[voice]) for _ in range(rng.randint(1, 12)))] * 7])
        rows.append((rng.choice([None, i, i]), text, rng.choice([None, "en", "fr", "zz", voice]), rng.choice([None, "org", "fr"]), rng.choice([None, "h0", "h1", "h2"]), 1.0, "g"))
    rows += rows[:10]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, suffix string, host string, mass double, guess string")
    train = spark.createDataFrame([(i, " ".join(rng.choice(voices[v]) for _ in range(20)), v) for i, v in enumerate(["en", "fr"] * 20)], "doc_id long, text string, lang string")
    model = lang_fusion.train(train, "lang", "doc_id", "text")
    fields = {"declared": F.col("lang"), "host": F.col("host")} | ({"suffix": F.col("suffix")} if suffix else {})
    got = collect(lang_fusion.fused(d, "doc_id", "text", model, **fields))
    want = _fused([(t, lang, s if suffix else None, h) for _, t, lang, s, h, *_ in rows], model, suffix=suffix)
    mine = sorted((str(r["doc_id"]), r["lang_pred"], r["accepted"], r["confidence"]) for r in got)
    for a, b in zip(mine, sorted((str(r[0]), w[0], bool(w[2]), w[1]) for r, w in zip(rows, want, strict=True)), strict=True):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-4
    assert 5 < sum(not w[2] for w in want) < 200
    kept = lang_fusion.accepted(d.where("doc_id is not null"), "doc_id", "text", model, **fields)
    assert kept.columns == d.columns


def test_language_of_pages_by_brute_force(spark, tmp_path):
    """Pages: text without markup, the declared language of the html tag, suffix and host of the address."""
    sf = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{sf}/pages.parquet").limit(40).unionByName(spark.createDataFrame([(10**6, None, None), (10**6 + 1, "nothing", "<html lang=EN><p>the and of</p>"), (10**6 + 2, "http://a.xx/", "")], "page_id long, url string, html string"))
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    spark.read.parquet(f"{sf}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.page_id: r for r in llm_queries.op5_language_id_pages(spark, str(tmp_path)).collect()}
    rows, ids = [], []
    for r in pages.collect():
        html = None if r.html is None else re.sub(r"(?is)<(script|style)\b.*?</\1>|<[^>]*>", " ", r.html)
        tag = re.search("(?i)<html[^>]*\\blang\\s*=\\s*[\"']?([A-Za-z]+)", r.html or "")
        at = re.search("(?s)^.*?://([^/?#]*)", r.url or "")
        host = (at.group(1).lower() if at else "") or None
        end = re.search(r"\.([a-z]+)$", host or "")
        rows.append((html, tag.group(1).lower() if tag else None, end.group(1) if end else None, host))
        ids.append(r.page_id)
    model = llm_queries.language_model(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    for i, (name, confidence, good) in zip(ids, _fused(rows, model, suffix=True), strict=True):
        assert (got[i].lang_pred, got[i].accepted) == (name, good) and abs(got[i].confidence - confidence) < 1e-6


def test_language_on_held_out_rows(spark):
    """Rows that no model has seen: by their text alone, with a wrong declaration and with none; and junk of no language."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    model = llm_queries.language_model(docs)
    rng = random.Random(53)
    held = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and len(WORD.findall(r.text)) >= 5]
    other = {"en": "fr", "fr": "de", "de": "es", "es": "en"}
    letters = "abcdefghijklmnopqrstuvwxyz"
    junk = ["".join(rng.choice(letters) for _ in range(300)) for _ in range(20)] + [" ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randint(3, 9))) for _ in range(40)) for _ in range(20)]
    assert len(held) > 150
    for kind, least in (("right", 0.98), ("wrong", 0.95), ("none", 0.98)):
        said = {"right": lambda r: r.lang, "wrong": lambda r: other[r.lang] if r.doc_id % 10 == 2 else r.lang, "none": lambda r: None}[kind]
        d = spark.createDataFrame([(r.doc_id, r.text, said(r), r.lang) for r in held] + [(-i - 1, t, None, None) for i, t in enumerate(junk)], "doc_id long, text string, said string, lang string")
        got = {r["doc_id"]: r for r in collect(lang_fusion.fused(d, "doc_id", "text", model, declared=F.col("said")))}
        judged = [r for r in held if kind != "wrong" or r.doc_id % 10 == 2]
        right = sum(got[r.doc_id]["lang_pred"] == r.lang for r in judged)
        assert right >= least * len(judged), (kind, right, len(judged))
        assert all(got[r.doc_id]["accepted"] for r in judged)
        assert sum(got[-i - 1]["accepted"] for i in range(len(junk))) == 0


def test_language_likelihoods_are_of_whole_rows():
    import pyarrow as pa

    from folioforge.llm.common import flat_bytes

    texts = ["abcd", None, "ab", "xyzxyz", "", "q" * 5]
    flat, at = flat_bytes(pa.array(texts))
    grams = lang_fusion._trigrams(flat)
    for t, a in zip(texts, at, strict=False):
        own = lang_fusion._trigrams(np.frombuffer((t or "").encode(), np.uint8))
        assert (grams[a : a + len(own)] == own).all()


def test_language_empty(spark):
    e = data.empty(spark)
    model = lang_fusion.train(e, "lang", "doc_id", "text")
    assert model[0] == [] and lang_fusion.fused(e, "doc_id", "text", model, declared=F.col("lang")).count() == 0


# --- 6 ---


def test_packing(spark, tokenizer):
    got = collect(residual_packing.packed(data.docs(spark), PATH))
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    want = Counter()
    for doc, text, *_ in data.rows():
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        for piece, (start, size) in enumerate(residual_packing.cut(len(ids))):
            want[doc, piece, start, size, zlib.crc32(ids[start : start + size].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    seq = defaultdict(list)
    for r in got:
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r["length"] for r in got)
    assert len(seq) <= -(-total // 1024) + 2


def test_packing_is_the_same_with_all_bins_sent(spark):
    """What travels is bounded without loss: as many sequences as with every underfull bin sent up."""
    rng = random.Random(61)
    rows = [(i, " ".join(rng.choice(data.WORDS) for _ in range(rng.choice([5, 40, 90, 150, 170, 260, 300])))) for i in range(1500)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(40, "doc_id")
    few = {s: collect(residual_packing.packed(d, PATH, spare=s, at_once=20)) for s in (None, 10**6, 0)}
    n = {s: len({r["sequence_id"] for r in got}) for s, got in few.items()}
    pieces = {s: sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) for s, got in few.items()}
    assert n[None] == n[10**6] <= n[0] and pieces[None] == pieces[10**6] == pieces[0]
    fills = Counter()
    for r in few[None]:
        fills[r["sequence_id"]] += r["length"]
    assert sum(f <= 512 for f in fills.values()) <= 1


def test_few_sequences_whatever_the_tasks(spark):
    rng = random.Random(12)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(data.WORDS) for _ in range(rng.choice([5, 60, 200, 420])))) for i in range(900)], "doc_id long, text string")
    made = {n: residual_packing.packed(docs.repartition(n), PATH).agg(F.countDistinct("sequence_id"), F.sum("length")).first() for n in (1, 7, 90)}
    assert len({m[1] for m in made.values()}) == 1
    assert max(m[0] for m in made.values()) <= 1.01 * min(m[0] for m in made.values()) + 1


def test_merges_leave_out_no_useful_bin():
    """Rounds over bins of random sizes, with the bound and without it."""
    import pyarrow as pa

    rng = random.Random(62)
    for _ in range(20):
        leaves = [[rng.choice([100, 520, 600, 601, 700, 900]) for _ in range(rng.randint(0, 60))] for _ in range(64)]
        ends = []
        for bounded in (True, False):
            level = [residual_packing._merged(p, p << 32, [[(0, 0, 0, n, 0, 0)] for n in sizes], None, 1024) for p, sizes in enumerate(leaves)]
            done = 0
            for left in (2, 1, 0):
                spare = residual_packing.FAN_IN * left if bounded else 10**9
                marked = [residual_packing._closed(b, 1024, 1, spare if left else 10**9) for b in level]
                done += sum(sum(b.column("closed").to_pylist()) for b in marked)
                still = [b.filter(pa.compute.invert(b.column("closed"))) for b in marked]
                if left:
                    level = [residual_packing._merged(p, p << 32, [], pa.concat_tables(still[8 * p : 8 * p + 8]), 1024) for p in range(len(still) // 8)]
            ends.append(done + sum(b.num_rows for b in still))
        assert ends[0] == ends[1]


def test_best_fit():
    rng = random.Random(6)
    for _ in range(50):
        sizes = [rng.randint(1, 100) for _ in range(rng.randint(0, 60))]
        bins = residual_packing.best_fit(sizes, 100)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= 100 for b in bins)
        assert sum(sum(sizes[i] for i in b) <= 50 for b in bins) <= 1
    assert residual_packing.cut(2500) == [(0, 452), (452, 1024), (1476, 1024)] and residual_packing.cut(1024) == [(0, 1024)] and residual_packing.cut(2048) == [(0, 1024), (1024, 1024)]


# --- 7 ---

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            d = pii_crf.digits_of(m.group())
            good = {"email": True, "ip": kind == "ip" and all(int(v) <= 255 for v in m.group().split(".")), "card": 13 <= len(d) <= 19 and pii_crf.luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append((kind, *m.span()))
    return out


def test_base_spans():
    rng = random.Random(3)
    parts = [*"a.@1-+ ()5_%", "1.2", "255", "4111111111111111", "@b.c", "é", "10.0.0.1", "+1 (555) 201-4477"]
    for _ in range(20_000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert pii_crf.base_spans(t) == _brute(t), t


def test_base_spans_take_linear_time():
    for t in ("a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "+1(" * 100_000, "a@" * 150_000):
        pii_crf.base_spans(t)


def test_field_adds_spans_and_leaves_clean_text():
    emit, move = pii_crf.trained()
    added = {"Call (555) 201-4477 now": "(555) 201-4477", "my number 555-123-9876 ok": "555-123-9876", "mail john (at) example dot com please": "john (at) example dot com"}
    for text, span in added.items():
        ((base, all_),) = pii_crf.spans_of([text], emit, move)
        assert not base and [text[a:b] for _, a, b in all_] == [span], text
    for text in ("Version 2.0 of 2019", "rows 100 200 300 400", "ISBN 978-3-16-148410-0", "on 2024-03-15 at 10:30", ""):
        assert pii_crf.spans_of([text], emit, move) == [([], [])]


#: Other sentences, names and words than those the field is trained on.
HELD_OUT = (
    "please ring <phone:(555) 201-4477> after lunch",
    "new line: <phone:555-201-4477> (evenings)",
    "office <phone:555.201.4477>",
    "reach Tom on <phone:0049 30 2014477> , weekdays",
    "his phone is <phone:555 201 4477> I think",
    "email me: <email:anna (at) mail dot example dot com>",
    "questions to <email:anna.b [at] example [dot] com> please",
    "support is <email:anna42 (at) example (dot) org>",
    "ping <email:carl [ AT ] mail [ DOT ] com>",
    "he signs as <email:carl at mail dot net> here",
    'auth_token = "<secret:{HEX}>"',
    "with api key <secret:{MIXED}> set",
    "SECRET={MIXED_SPAN}",
    'db password: "<secret:{PASS}>"',
    "Bearer <secret:{HEX}>",
    "log says token: <secret:{MIXED}> expired",
)
HELD_CLEAR = (
    "release 3.1.4 came out in 2018",
    "a table of 12 by 40 rows and 7 columns",
    "the md5 checksum {HEX} matched",
    "at commit {HEX} it broke",
    "on 2021-07-14 between 09:15 and 17:45",
    "pages 44-57, 61 and 90",
    "chapter 2.3.1 , figure 8",
    "sold for 2,450.00 at last",
    "a dot too far (at 45 degrees)",
    "isbn 978-0-12-374856-0",
    "game 3 ended 101-99 in 1987",
    "ratio of 3:2 at 60 Hz",
)


def test_field_on_held_out_sentences():
    """Precision and recall of the spans that the field adds, over sentences it isn't trained on."""
    emit, move = pii_crf.trained()
    marked = tuple(s.replace("{MIXED_SPAN}", "<secret:{MIXED}>") for s in HELD_OUT)
    table = pii_crf.filled((*marked, *HELD_CLEAR), 15, np.random.default_rng(99), names=["ines", "ruth", "karl", "uwe"], fills="some other words that were not seen before in training at all".split())
    assert not {t for t, _ in table} & {t for t, _ in pii_crf.labelled_table()}
    found = pii_crf.spans_of([t for t, _ in table], emit, move)
    right = wrong = missed = 0
    for (_, want), (base, spans) in zip(table, found, strict=True):
        added, wanted = set(spans) - set(base), set(want) - set(base)
        right, wrong, missed = right + len(added & wanted), wrong + len(added - wanted), missed + len(wanted - added)
    precision, recall = right / (right + wrong), right / (right + missed)
    assert precision >= 0.95 and recall >= 0.8, (precision, recall)


def test_no_span_is_cut():
    """A window grows through any length of text without blanks."""
    emit, move = pii_crf.trained()
    text = "x" * 9000 + "," + "call 555-201-4477 now, token = \"" + "0a1b2c3d" * 5 + "\"" + ",y" * 9000 + " end"
    ((base, spans),) = pii_crf.spans_of([text], emit, move)
    assert {(k, text[a:b]) for k, a, b in spans} >= {("secret", "0a1b2c3d" * 5)}
    assert all(0 <= w[0][0] and w[-1][1] <= len(text) for w in pii_crf._windows(text))
    flat = [t for w in pii_crf._windows(text + " 1 " + text) for t in w]
    assert flat == sorted(set(flat))


def test_given_secrets_are_found(spark):
    """Every quoted token of the given table, and none elsewhere but where a number stands."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in rows.collect()}
    want = {(i, m.start(1), m.end(1)) for i, t in texts.items() for m in re.finditer(r'token = "([0-9a-f]{16,})"', t)}
    got = {(r["doc_id"], int(s.split(":")[1]), int(s.split(":")[2])) for r in collect(pii_crf.found(rows)) for s in r["spans"].split(",") if s.startswith("secret")}
    assert len(want) > 5 and len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(got)


def test_windows_lose_nothing_of_a_full_decode():
    """The field over whole texts finds what it finds in windows, in corpus texts and in marked sentences among them."""
    import pandas as pd

    emit, move = pii_crf.trained()
    corpus = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")["text"].fillna("").tolist()
    marked = [t for t, _ in pii_crf.labelled_table(3, seed=11)]
    texts = [t for t in corpus if len(t) < 20_000] + marked + [f"{c[:2000]} {m} {c[2000:4000]}" for c, m in zip(corpus, marked, strict=False)]
    assert pii_crf.spans_of(texts, emit, move) == pii_crf.spans_of(texts, emit, move, every=True)
    tokens = sum(len(pii_crf._tokens(t)) for t in corpus)
    inside = sum(len(w) for t in corpus for w in pii_crf._windows(t))
    assert 0 < inside < 0.1 * tokens


def test_marked_sentences_are_labelled_as_marked():
    emit, move = pii_crf.trained()
    wrong = 0
    table = pii_crf.labelled_table(1)
    for text, spans in table:
        rows, tags = pii_crf._tagged(text, spans)
        wrong += (pii_crf.viterbi([rows], emit, move)[0] != tags).any()
    assert wrong <= 0.02 * len(table)


def test_viterbi_is_the_best_path():
    import itertools

    rng = np.random.default_rng(1)
    n_labels = len(pii_crf.LABELS)
    emit, move = rng.normal(size=(pii_crf.BUCKETS, n_labels)), rng.normal(size=(n_labels, n_labels))
    rows = [rng.integers(0, pii_crf.BUCKETS, (n, 12)) for n in (1, 3, 4)]
    for row, got in zip(rows, pii_crf.viterbi(rows, emit, move), strict=True):
        def score(path, row=row):
            if pii_crf.LABELS[path[0]].startswith("I-") or any(not pii_crf.ALLOWED[a, b] for a, b in itertools.pairwise(path)):
                return -1e9
            return sum(emit[row[i], p].sum() for i, p in enumerate(path)) + sum(move[a, b] for a, b in itertools.pairwise(path))

        best = max(itertools.product(range(n_labels), repeat=len(row)), key=score)
        assert tuple(got) == best


def test_personal_data_query(spark):
    got = {r["doc_id"]: r for r in collect(pii_crf.found(data.docs(spark)))}
    for r in data.rows():
        base = _brute(r[1] or "")
        assert got[r[0]]["base_sha256"] == hashlib.sha256(pii_crf.shown(base).encode()).hexdigest()


# --- 8 ---


def _toxic(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(400):
        w = data.words(rng, 60).split(" ")
        bad = i % 4 == 0
        for _ in range(3 if bad else 0):
            w[rng.randrange(60)] = rng.choice(["scumbag", "worthless", "idiotic"])
        rows.append((i, " ".join(w), None, None, None, None, None, None, None))
        labels.append((i, int(bad)))
    return spark.createDataFrame([*rows, (1000, None, *[None] * 7), (1001, "", *[None] * 7)], data.SCHEMA), spark.createDataFrame([*labels, (3, None), (10**9, 1)], "doc_id long, toxic int"), labels


def test_toxicity_on_held_out_rows(spark):
    docs, labels, truth = _toxic(spark)
    out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = zstd_toxicity.train(docs, labels.where(~out))
    got = {r["doc_id"]: r["score"] for r in collect(zstd_toxicity.scored(docs, model))}
    held = [(got[i], bad) for i, bad in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((s >= 0.3) == bool(b) for s, b in held)
    assert right >= 0.9 * len(held) and all(0 <= s <= 1 for s in got.values()) and got[1000] == got[1001] < 0.3


def test_toxicity_learns_from_long_texts(spark):
    """All labelled texts are longer than the sample's stretches; the given corpus is told apart on held-out rows."""
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(120):
        w = data.words(rng, 4000).split(" ")
        for k in range(0, 4000, 12) if i % 3 == 0 else ():
            w[k] = rng.choice(["scumbag", "worthless", "idiotic"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 3 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert min(len(t) for _, t in rows) > zstd_toxicity.LONGEST_SAMPLE
    model = zstd_toxicity.train(docs, spark.createDataFrame(labels[:90], "doc_id long, toxic int"))
    got = {r["doc_id"]: r["score"] for r in collect(zstd_toxicity.scored(docs, model))}
    held = labels[90:]
    order = sorted(range(len(held)), key=lambda k: got[held[k][0]])
    ones = [rank for rank, k in enumerate(order) if held[k][1]]
    auc = (sum(ones) - len(ones) * (len(ones) - 1) / 2) / (len(ones) * (len(held) - len(ones)))
    assert auc >= 0.95, auc


def test_toxicity_of_null_and_repeated_rows(spark):
    """Null ids are never held out; repeated rows have equal scores; columns with the output's names are not read."""
    docs, labels, _ = _toxic(spark)
    model = zstd_toxicity.train(docs, labels)
    d = spark.createDataFrame([(None, "scumbag text"), (1, "some text"), (1, "some text")], "doc_id long, text string").withColumn("score", F.lit(9.0)).withColumn("toxic", F.lit(1))
    got = collect(zstd_toxicity.scored(d, model))
    assert Counter(r["doc_id"] for r in got) == Counter({None: 1, 1: 2}) and len({r["score"] for r in got if r["doc_id"] == 1}) == 1


def _plain_score(model, text):
    """A score from its definition: windows, sizes under each dictionary, features, logistic curve."""
    import zstandard

    def sizes(content):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters(**zstd_toxicity.PARSE, write_content_size=False, write_checksum=False, write_dict_id=False)
        return [len(zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress(p)) for p in parts]

    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    parts = []
    while raw:
        space = raw.find(b" ", zstd_toxicity.WINDOW, 4 * zstd_toxicity.WINDOW)
        end = space if space >= 0 else 4 * zstd_toxicity.WINDOW if len(raw) > zstd_toxicity.WINDOW else len(raw)
        parts.append(raw[:end])
        raw = raw[end:]
    saved = [b - a for a, b in zip(sizes(model.toxic), sizes(model.ordinary), strict=True)]
    if saved:
        top, n = sorted(saved, reverse=True), len(saved)
        mean = sum(saved) / n
        quarter = top[: max(1, n // 4)]
        features = [mean, top[0], sum(quarter) / len(quarter), top[-1], mean * n**0.5, math.log1p(n)]
    else:
        features = [0.0] * 6
    z = model.weights[0] + sum(w * (f - c) / s for w, f, c, s in zip(model.weights[1:], features, model.center, model.scale, strict=True))
    return 1 / (1 + math.exp(-z))


def test_toxicity_scores_by_brute_force(spark):
    docs, labels, _ = _toxic(spark)
    model = zstd_toxicity.train(docs, labels)
    assert model.toxic and model.ordinary
    more = spark.createDataFrame([(9001, None), (9002, ""), (9003, "x" * 9000), (9004, "Ünï " * 700), (9005, "A b\n" * 400)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(more)
    texts = {r.doc_id: r.text for r in both.collect()}
    got = {r.doc_id: r.score for r in zstd_toxicity.scored(both, model).collect()}
    assert got.keys() == texts.keys()
    for doc_id in [*list(texts)[::9], 9001, 9002, 9003, 9004, 9005]:
        assert abs(got[doc_id] - _plain_score(model, texts[doc_id])) < 1e-9


def test_toxic_dictionary_keeps_its_best_end(monkeypatch):
    """Of a trained dictionary that doesn't fit beside the frequent stretches the header goes, not the end."""
    made = bytes(range(256)) * 32
    monkeypatch.setattr(zstd_toxicity, "_stretches", lambda toxic, ordinary: [b"often so"] * 3 + [b"seldom"])
    monkeypatch.setattr(zstd_toxicity, "_dictionary", lambda samples: made if b"seldom" in samples else b"plain")
    toxic, plain = zstd_toxicity._pair([b"x y"], [b"a b c"])
    assert plain == b"plain" and toxic == made[-(zstd_toxicity.DICT_BYTES - 8) :] + b" often so plain"


def test_toxicity_without_labels(spark):
    e = data.empty(spark)
    model = zstd_toxicity.train(e, spark.createDataFrame([], "doc_id long, toxic int"))
    assert zstd_toxicity.scored(e, model).count() == 0 and model.scorer().score(b"x") == 0.5


def test_windows_are_the_text():
    for t in (b"", b"a", b"a b " * 500, b"x" * 5000, b" " * 3000):
        assert b"".join(zstd_toxicity.windows(t)) == t


# --- 9 ---


def _targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(3 * sizes[s] for s in capped)
        level = rest / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in capped else weight[s] * level for s in order}
        capped |= over


def test_mixing(spark):
    got = collect(apportion_mix.shares(data.docs(spark), block_words=4, shard_words=2000))
    again = collect(apportion_mix.shares(data.docs(spark).repartition(7), block_words=4, shard_words=2000))
    key = lambda r: tuple(str(v) for v in r.values())
    assert sorted(got, key=key) == sorted(again, key=key)
    sizes = Counter()
    for r in data.rows():
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    want = _targets(sizes)
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 4 * 12


def test_sainte_lague(spark):
    rng = random.Random(12)
    for house in (0, 1, 2, 7, 50, 1000):
        claims = {f"p{i}": rng.choice([0.0, 1.0, rng.random() * 100, rng.random() * 5]) for i in range(9)}
        heap = sorted(((-c / (2 * k + 1), p) for p, c in claims.items() if c > 0 for k in range(house + 1)))[:house]
        df = spark.createDataFrame([(1, p, c, house) for p, c in claims.items()], "g int, p string, claim double, house long")
        got = {r["p"]: r["seats"] for r in collect(apportion_mix.seats(df, ["g"], ["p"], "claim", "house"))}
        assert got == {p: sum(q == p for _, q in heap) for p in claims}


def _apportioned(claims, house):
    """Sainte-Laguë by a heap; ties go to the first by name."""
    heap = [(-c / 1, p, 0) for p, c in claims.items() if c > 0]
    heapq.heapify(heap)
    got = dict.fromkeys(claims, 0)
    for _ in range(house if heap else 0):
        _, p, k = heapq.heappop(heap)
        got[p] += 1
        heapq.heappush(heap, (-claims[p] / (2 * k + 3), p, k + 1))
    return got


def test_mix_by_brute_force(spark):
    """What each document gives: seats of sources, groups and shards, then documents in seeded order.

    Among the rows are null ids, repeated rows, a null source and columns of clashing names."""
    rng = random.Random(91)
    rows = [(rng.choice([None, i, i, i]), data.words(rng, rng.choice([0, 1, 5, 40, 300])), rng.choice([None, "a", "b", "b", "b", "B", "é"]), "x", 1) for i in range(700)]
    rows += rows[:30] + [(None, None, "a", None, None)] * 3
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, name string, shard long").repartition(3)
    block, shard_words, seed = 4, 1500, apportion_mix.SEED
    got = collect(apportion_mix.shares(d, block_words=block, shard_words=shard_words))
    draw = F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit(seed))
    drawn = d.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"), draw.alias("draw"), F.xxhash64(draw, F.lit(seed + 1)).alias("at")).collect()
    sizes, parts, size_of = Counter(), Counter(), lambda r: len(WORD.findall(r.text))
    for r in drawn:
        sizes[r.source] += size_of(r)
    shards = {s: max(1, -(-n // shard_words)) for s, n in sizes.items()}
    target = _targets(sizes)
    seats = _apportioned({(s is None, s or ""): target[s] for s in sizes}, round(sum(target.values()) / block))
    members = defaultdict(list)
    for r in drawn:
        members[r.source, r.draw % shards[r.source]].append(r)
    for key, mine in members.items():
        parts[key] = sum(map(size_of, mine))
    want = Counter()
    for s in sizes:
        per = math.ceil(math.sqrt(shards[s]))
        groups = Counter()
        for (source, shard), n in parts.items():
            if source == s:
                groups[shard // per] += n
        for g, n in _apportioned(groups, seats[(s is None, s or "")]).items():
            inside = {k[1]: v for k, v in parts.items() if k[0] == s and k[1] // per == g}
            for shard, won in _apportioned(inside, n).items():
                whole = inside[shard]
                quota, at = min(won * block, 3 * whole), 0
                for r in sorted(members[s, shard], key=lambda r: (r.at, r.doc_id is not None, r.doc_id or 0, size_of(r))):
                    n_words = size_of(r)
                    once = min(max(quota % whole - at, 0), n_words) if whole else 0
                    want[r.doc_id, s, n_words, (quota // whole * n_words if whole else 0) + once] += 1
                    at += n_words
    assert Counter((r["doc_id"], r["source"], r["size"], r["taken"]) for r in got) == want


def test_mixed_rows(spark):
    d = data.docs(spark).dropDuplicates(["doc_id"])
    out = apportion_mix.mixed(d, block_words=4)
    assert out.columns == d.columns
    words = Counter()
    for r in out.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
    want = {r["doc_id"]: r["taken"] for r in collect(apportion_mix.shares(d, block_words=4)) if r["taken"]}
    assert words == want


def test_mix_takes_documents_whole(spark):
    """No source, and none below its target least of all, consists of documents' beginnings."""
    rng = random.Random(21)
    rows = [(i, data.words(rng, rng.choice([30, 200, 400])), f"s{i % 3}") for i in range(240)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    shares = collect(apportion_mix.shares(d, shard_words=20_000))
    assert any(r["target"] < 0.8 * r["source_size"] for r in shares)
    total = sum(len(t.split()) for _, t, _ in rows)
    cut = Counter(r["source"] for r in shares if r["taken"] % r["size"])
    assert cut and max(cut.values()) <= -(-total // 20_000)  # one a shard
    text_of = {i: t for i, t, _ in rows}
    got = Counter((r.source, r.text == text_of[r.doc_id]) for r in apportion_mix.mixed(d, shard_words=20_000).collect())
    assert all(got[f"s{k}", True] > 5 and got[f"s{k}", False] <= -(-total // 20_000) for k in range(3))


# --- 10 ---


def test_flac_round_trip():
    rng = np.random.default_rng(13)
    texts = [b"", b"x", b"a" * 576, b"some text. " * 400, rng.bytes(5000), bytes(4000), bytes([0, 255]) * 1500, (np.arange(6000) // 3 % 256).astype(np.uint8).tobytes()]
    payloads = [flac_media.payload_of(t) for t in texts]
    streams = flac_media.encode(payloads)
    for p, s, d in zip(payloads, streams, flac_media.decode(streams), strict=True):
        assert (d + 128).astype(np.uint8).tobytes() == p
        for at in range(0, len(p), 1000):
            assert (flac_media.block_at(s, at) == d[at // flac_media.FRAME * flac_media.FRAME :][: flac_media.FRAME]).all()
        bare = s[:4] + b"\x80" + s[5:42] + s[46 + int.from_bytes(s[43:46], "big") :]  # without seek points
        assert (flac_media.decode([bare])[0] == d).all()
    for at in (-1, -100, -300):
        broken = bytearray(streams[3])
        broken[at] ^= 4
        with pytest.raises(flac_media.BrokenStream):
            flac_media.decode([bytes(broken)])


def _bits(fields):
    text = "".join(f"{v & ((1 << n) - 1):0{n}b}" if n else "" for v, n in fields)
    return int(text + "0" * (-len(text) % 8), 2).to_bytes((len(text) + 7) // 8, "big")


def test_flac_reads_other_encoders_frames():
    """Rice coding of 5-bit parameters, several partitions, an escaped one, a fixed predictor of order 3."""
    rng = np.random.default_rng(14)
    x = np.cumsum(rng.integers(-2, 3, 192)).clip(-100, 100)
    res = [int(x[t] - 3 * x[t - 1] + 3 * x[t - 2] - x[t - 3]) for t in range(3, 192)]
    fields = [((8 + 3) << 1, 8), *[(int(v), 8) for v in x[:3]], (1, 2), (1, 4)]
    for part in (res[:93], res[93:]):
        if part is res[:93] or len(part) == 93:
            fields += [(31, 5), (10, 5), *[(r, 10) for r in part]]
        else:
            fields.append((2, 5))
            for r in part:
                u = (r << 1) ^ (r >> 63)
                fields += [(1, (u >> 2) + 1), (u & 3, 2)]
    head = b"\xff\xf8" + bytes([0x14, 0x02, 0])
    frame = head + bytes([flac_media.crc8(head)]) + _bits(fields)
    crc = int(flac_media.crc16(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]))[0])
    info = (192).to_bytes(2, "big") * 2 + bytes(6) + ((8000 << 44) | (7 << 36) | 192).to_bytes(8, "big") + bytes(16)
    stream = b"fLaC\x80" + (34).to_bytes(3, "big") + info + frame + crc.to_bytes(2, "big")
    assert (flac_media.decode([stream])[0] == x).all()


def test_media_query(spark):
    got = collect(flac_media.read_back(flac_media.media_table(data.docs(spark))))
    text_of = {r[0]: (r[1] or "").encode() for r in data.rows()}
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in data.rows())
    by_text = {}
    for r in got:
        t = text_of[r["doc_id"]]
        p = t + b"\xff" * (-len(t) % 576 if t else 576)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert by_text.setdefault(t, (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])


def test_media_features():
    """The feature string against plain Python over the samples."""
    payload = flac_media.payload_of("Some words, é, and 12 numbers. ".encode() * 30)
    x = [b - 128 for b in payload]
    turns = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))
    want = f"n={len(x)};mean={sum(x) / len(x):.4f};rms={(sum(v * v for v in x) / len(x)) ** 0.5:.4f};zcr={turns / (len(x) - 1):.6f};peak={max(map(abs, x))}"
    assert flac_media.features(flac_media.decode(flac_media.encode([payload]))[0]) == want


def test_pcm_blocks_are_sought_by_sample(spark):
    """Single samples from the written table, among them those of a null id's and of a very long text."""
    rows = [(1, "a b c " * 3000), (2, ""), (3, None), (4, "x" * 5000), (None, "no id"), (5, "".join(map(chr, range(32, 900)))), (6, "long " * 400_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    media = flac_media.media_table(d)
    blocks = flac_media.pcm_blocks(media)
    payload = {i: flac_media.payload_of((t or "").encode()) for i, t in rows}
    got = defaultdict(list)
    for r in blocks.collect():
        assert r.first_sample == r.block * flac_media.PCM_BLOCK and r.n_samples == len(r.pcm)
        got[r.doc_id].append((r.block, bytes(b ^ 128 for b in r.pcm)))
    assert {i: b"".join(p for _, p in sorted(v)) for i, v in got.items()} == payload
    asked = [(i, at) for i in (1, 2, 4, 5, 6, 99) for at in (0, 1, 575, 576, 4608, 10_000, 1_999_999, 10**9)]
    found = {(r.doc_id, r.sample): r.value for r in flac_media.samples_at(blocks, spark.createDataFrame(asked, "doc_id long, sample long")).collect()}
    assert found == {(i, at): payload[i][at] - 128 for i, at in asked if at < len(payload.get(i, b""))}


# --- all ---


def test_empty_tables(spark):
    e = data.empty(spark)
    assert pfor_tokens.read_files(pfor_tokens.write_files(e, PATH)).count() == 0
    assert chunk_dedup.groups(e).count() == 0
    assert chosen_path.components(e).count() == 0
    assert residual_packing.packed(e, PATH).count() == 0
    assert pii_crf.found(e).count() == 0
    assert apportion_mix.shares(e).count() == 0 and apportion_mix.mixed(e).count() == 0
    assert flac_media.read_back(flac_media.media_table(e)).count() == 0


def test_null_ids(spark):
    d = spark.createDataFrame([(None, "a b c d e f", None, None, *[None] * 5), (1, "a b c d e f", None, None, *[None] * 5)], data.SCHEMA)
    assert {r["doc_id"] for r in collect(pfor_tokens.read_files(pfor_tokens.write_files(d, PATH)))} == {None, 1}
    assert {r["doc_id"]: r["kept"] for r in collect(chunk_dedup.groups(d))} == {None: False, 1: True}
    assert {r["doc_id"]: r["kept"] for r in collect(chosen_path.components(d))} == {None: True, 1: True}
    assert {r["doc_id"] for r in collect(residual_packing.packed(d, PATH))} == {None, 1}
    assert {r["doc_id"] for r in collect(apportion_mix.shares(d))} == {None, 1}
    assert {r["doc_id"] for r in collect(pii_crf.found(d))} == {None, 1}
    assert {r["doc_id"] for r in collect(flac_media.read_back(flac_media.media_table(d)))} == {None, 1}
