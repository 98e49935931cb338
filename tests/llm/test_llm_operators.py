"""The text operators against brute force on small fixtures, and at their edges."""

import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paceline.llm import bpe, bytewise, chat, edits, encoding, fastids, fingerprints, minhash, packing, pii, quality, queries, toxicity, urls
from paceline.llm.store import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = [None, "", " \n\t ", "a", "one two three", "é " * 40, "x\x1cy\x85z", "word " * 5000, "<|endoftext|>", "中文 🙂 ½ ²", "mail bob@site.example.com now"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, node long"


def frame(spark, texts, ids=None):
    """Documents with further columns whose names the operators use themselves."""
    rows = [(i, t, None if k % 7 == 3 else "en", "s1", len(t or ""), 0.5, False, 1) for k, (i, t) in enumerate(zip(ids or range(len(texts)), texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, n, words=400):
    vocab = ["".join(rng.choice("aeioustrnl") for _ in range(rng.randrange(2, 8))) for _ in range(words)]
    return " ".join(rng.choice(vocab) for _ in range(n))


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(bpe.DEFAULT)


# words and hashes -------------------------------------------------------------------------------------------


def test_words_are_those_of_the_pattern():
    import pyarrow as pa

    texts = EDGES + ["\u2003thin\u00a0space  b", "tail "]
    data, offsets = bytewise.utf8(pa.array(texts))
    w = bytewise.Words(data, offsets)
    for k, t in enumerate(texts):
        got = [w.data[a:b].tobytes().decode() for a, b in zip(w.starts[w.row[k] : w.row[k + 1]], w.ends[w.row[k] : w.row[k + 1]], strict=True)]
        assert got == WORD.findall(t or "")
    lower = bytewise.Words(data, offsets, lower=True)
    upper = bytewise.Words(*bytewise.utf8(pa.array([t and re.sub("[a-z]", lambda m: m[0].upper(), t) for t in texts])), lower=True)
    assert (lower.hashes == upper.hashes).all()


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from paceline.llm import store

    session = lambda master, folder=None: SimpleNamespace(conf={"spark.checkpoint.dir": folder} if folder else {}, sparkContext=SimpleNamespace(master=master, applicationId="app-1"))
    assert store.shared_dir(session("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    for master in ("yarn", "spark://a:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError):
            store.shared_dir(session(master))
    assert store.shared_dir(session("local[4]")).startswith("file:///tmp/")


# op 1 -------------------------------------------------------------------------------------------------------


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = sum(1 for i, x in enumerate(lines) if x in lines[:i])
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n, inside = Counter(runs), set()
    for i, r in enumerate(runs):
        if n[r] > 1:
            inside.update(range(i, i + 8))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def test_quality_base_counts(spark):
    rng = random.Random(1)
    texts = EDGES + ["a b c d e f g h " * 3, "l1 x\nl2 y\nl1 x\n\nl1 x"] + [prose(rng, rng.randrange(60), 3) + "\n" + prose(rng, 30, 5) for _ in range(60)]
    for r in quality.quality(frame(spark, texts)).collect():
        want = base_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, texts[r.doc_id]
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


def test_quality_rejects_outliers_and_keeps_the_rest(spark):
    rng = random.Random(2)
    clean = [prose(rng, rng.randrange(80, 900)) for _ in range(400)]
    junk = [" ".join(w + "$$$" for w in prose(rng, 200).split()) for _ in range(30)]
    rows = {r.doc_id: r.kept for r in quality.quality(frame(spark, clean + junk)).collect()}
    assert all(rows[i] for i in range(400))
    assert not any(rows[i] for i in range(400, 430))


def plain_mcd(v, floor, rng, starts=40):
    """Reweighted FAST-MCD on the rows of v by random starts, with exact subsets and simulated consistency factors."""
    n, p = v.shape
    h = int(np.ceil(0.75 * n))
    normal = rng.standard_normal((400_000, p))
    size = np.sort((normal**2).sum(1))

    def factor(share):
        inner = normal[(normal**2).sum(1) <= size[int(share * len(size)) - 1]]
        return 1 / inner.var(axis=0).mean()

    def moments(rows, widen):
        centre = rows.mean(axis=0)
        cov = np.cov(rows.T, bias=True) * widen
        return centre, cov + np.diag(np.maximum(floor**2 - np.diag(cov), 0))

    def distances(centre, cov):
        return np.einsum("ni,ij,nj->n", v - centre, np.linalg.inv(cov), v - centre)

    best = None
    for _ in range(starts):
        inner = v[rng.choice(n, p + 1, replace=False)]
        for _ in range(30):
            inner = v[np.argsort(distances(*moments(inner, factor_h := 1.0)), kind="stable")[:h]]
        det = np.linalg.slogdet(moments(inner, factor_h)[1])[1]
        if best is None or det < best[0]:
            best = det, inner
    raw = moments(best[1], factor(0.75))
    inner = v[distances(*raw) <= size[int(0.975 * len(size))]]
    return distances(*moments(inner, factor(0.975)))


def points_of(spark, v):
    """Points as fit() takes them, of one group."""
    columns = ", ".join(f"x{i} long" for i in range(quality.P))
    return spark.createDataFrame([("en", "s", *map(int, r)) for r in v], f"g_lang string, g_source string, {columns}")


def test_mcd_matches_a_plain_one(spark):
    """A normal cloud with two kinds of outliers, one of them dense: distances equal those of an independent search."""
    rng = np.random.default_rng(3)
    p = quality.P
    mix = rng.standard_normal((p, p)) * 300 + np.eye(p) * 400
    v = np.vstack([rng.standard_normal((700, p)) @ mix, rng.standard_normal((80, p)) * 30 + 6000, rng.standard_normal((60, p)) * 9000])
    v = np.round(v)
    floor = np.array(list(quality.FEATURES.values())) * quality.UNIT
    want = plain_mcd(v, floor, rng)
    x = points_of(spark, v).withColumn("g_lang", F.lit(None).cast("string"))
    judged = quality._with(x.withColumn("at", F.monotonically_increasing_id()), quality.fit(x)).withColumn("d", quality._distance()).orderBy("at").select("d", "floored").collect()
    got = np.array([r.d for r in judged])
    assert np.allclose(got[:700], want[:700], rtol=0.15, atol=0.5)
    assert ((got > quality.LIMIT) == (want > quality.LIMIT)).mean() > 0.995 and (got[700:780] > quality.LIMIT).all()
    assert 0.9 < got[:700].mean() / p < 1.15 and {r.floored for r in judged} == {int((np.std(v[:700], axis=0) < floor).sum())}


def test_mcd_constants():
    assert quality.P == 7 and abs(quality.consistency(0.75) - 1.325) < 2e-3 and abs(quality.quantile(0.975, 7) - 16.0128) < 1e-3
    assert abs(1 - quality.chi_squared(quality.LIMIT, 7) - 1e-9) < 1e-11


def test_mcd_of_copies_and_few_rows(spark):
    """A group of one vector, and one row, have estimates; groups are measured by the rows that pass the base rules."""
    for n in (1, 300):
        e = quality.fit(points_of(spark, [[5] * quality.P] * n)).collect()
        assert len(e) == 1 and e[0].c0 == 5 and e[0].floored == quality.P
    assert quality.fit(points_of(spark, [])).count() == 0
    rng = random.Random(4)
    texts = ["short"] * 500 + [prose(rng, 100) for _ in range(30)]
    rows = quality.quality(frame(spark, texts)).collect()
    assert all(r.kept for r in rows if r.doc_id >= 500) and not any(r.kept for r in rows if r.doc_id < 500)


def test_long_words_are_measured_in_characters(spark):
    docs = frame(spark, ["короткоеслово длинноеслово" * 1 + " a", "x" * 24, "x" * 25, "ж" * 24, "ж" * 25])
    assert [r.long_words for r in quality.statistics(docs.select("doc_id", "text")).orderBy("doc_id").collect()] == [0, 0, 1, 0, 1]


# op 2 -------------------------------------------------------------------------------------------------------

PII_TEXTS = EDGES + [
    "write a.b+c@x-1.example.org, or call +1 (743) 555-3824 now", "ip 10.0.0.300 and 10.0.0.30.7 at 1.2.3.4", "card 4111 1111 1111 1111, no 4111-1111-1111-1112 end", "tel (743) 555-3824 and jane at site dot com",
    "+12 +123456789 ++1 (2) 345-67-89", "a@b a@b.c @x.y a@-.- 4111111111111111.2.3.4", "iban DE44500105175407324931 order 123-45-6789",
]


def plain_spans(text):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        check = sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])
        if 12 <= len(d) <= 19 and check % 10 == 0:
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found, key=lambda s: (s[1], pii.BASE_KINDS.index(s[0])))


def test_pii_base_spans_and_digests(spark):
    docs = frame(spark, PII_TEXTS)
    rows = pii.digests(pii.detect(docs, pii.fit(docs))).collect()
    assert len(rows) == len(PII_TEXTS)
    for r in rows:
        want = plain_spans(PII_TEXTS[r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in pii.BASE_KINDS]
        assert r.base_sha256 == pii.digest(want)
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r.spans.split(",")) | {""}


def test_em_finds_which_labelers_to_trust():
    rng = random.Random(5)
    good, counts = [0.95, 0.9, 0.85, 0.6, 0.55, 0.8, 0.7], Counter()
    for _ in range(4000):
        y = rng.random() < 0.5
        counts["email_words", tuple((1 if y == (rng.random() < g) else -1) if rng.random() < 0.9 else 0 for g in good)] += 1
    model = pii.train([(k, v, n) for (k, v), n in counts.items()])
    shares = [yes for yes, _ in model.reliability]
    assert shares[0] > shares[3] and shares[1] > shares[4]
    assert model.score("email_words", (1,) * 7) > 0.9 and model.score("email_words", (-1,) * 7) < 0.1
    assert pii.train([]).kinds.keys() == set(pii.KINDS)


def test_base_spans_match_the_patterns_on_noise():
    rng = random.Random(22)
    for _ in range(4000):
        text = "".join(rng.choice("a1.@-_+ ()é2345") for _ in range(rng.randrange(40)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_overlaps_are_settled_as_by_comparing_all():
    rng = random.Random(42)
    for _ in range(300):
        text = " ".join(rng.choice(["555-123-4567", "(212) 555-1234", "123-45-6789", "+1 555 123 4567", "4111 1111 1111 1111", "DE44500105175407324931", "x", "jo at site dot com", "1.2.3.4", "a@b.cd"]) for _ in range(12))
        text = text.replace(" ", "", rng.randrange(3))
        base = pii.base_spans(text)
        more = sorted(((k, *m.span()) for k in ("phone_local", "account") for m in pii._PATTERNS[k].finditer(text)), key=pii._order)
        more = sorted(more + [("email_words", *m.span()) for m in pii._PATTERNS["email_words"].finditer(text)], key=pii._order)
        taken, out = [(a, b) for _, a, b in base], [(*s, True) for s in base]
        for k, a, b in more:
            if not any(a < y and x < b for x, y in taken):
                taken.append((a, b))
                out.append((k, a, b, False))
        assert pii.candidates(text) == sorted(out, key=pii._order)


def test_very_long_runs_take_linear_time():
    n = 300_000
    began = time.time()
    assert len(pii.candidates("555-123-4567 " * 200_000)) == 200_000
    for text in ("a" * n + " @", "1" * n, "@" * n, "1." * n, "+" * n, "+1" + "-" * n, "\\" * n, "<" * n, "x" * n):
        pii.candidates(text)
        chat.render("user", text)
        quality.repeated_words(text.split())
        toxicity.Grammar(toxicity.Model()).document(text)
        fingerprints.canonical(text)
    assert time.time() - began < 60


def test_redaction_leaves_no_base_span(spark):
    docs = frame(spark, PII_TEXTS)
    out = pii.redact(docs, pii.fit(docs))
    assert out.columns == docs.columns
    for r in out.collect():
        assert (r.text is None) == (PII_TEXTS[r.doc_id] is None)
        assert not plain_spans(r.text or "") and (r.text is None or r.n_chars == len(r.text))


# op 3 -------------------------------------------------------------------------------------------------------


def judged(url, rules, blocked):
    host = path = ""
    if url and "://" in url:
        rest = re.split(r"[?#]", url.split("://", 1)[1])[0]
        host, slash, tail = rest.partition("/")
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = slash + tail
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else ("block" if blocked(host) else "allow")


def test_urls_against_plain_rules(spark):
    pages = [None, "", "no scheme", "http://", "http://a.org", "http://a.org/", "HTTP://X.Example.ORG/es/1?q#f", "http://example.org/en/12", "https://spam-farm.example.net/x", "http://b.com/fr/x#y", "http://b.com?/de/", "x://com/de/", "a://b://c.org/", "http://.org/", "http://évil.adult-x.io/É"]
    df = spark.createDataFrame([(i, u, "x", "allow") for i, u in enumerate(pages)], "page_id long, url string, host string, verdict string")
    labels = re.compile(rf"(^|\.)({'|'.join(queries.BLOCKED_LABELS)})\.")
    hosts = sorted({judged(u, [], bool)[0] for u in pages})
    listed = spark.createDataFrame([(h, "x") for h in hosts if labels.search(h)] * 2 + [(None, "x"), ("", "x"), ("elsewhere.org", "x")], "host string, path string")
    nothing = listed.limit(0)
    got = urls.judge(df, queries.URL_RULES, listed).collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == judged(pages[r.page_id], queries.URL_RULES, labels.search), pages[r.page_id]
    assert urls.judge(df.limit(0), queries.URL_RULES, listed).count() == 0
    everything = spark.createDataFrame([(h,) for h in hosts], "host string")
    assert {r.verdict for r in urls.judge(df, [], everything).collect() if r.host} == {"block"}
    assert {r.verdict for r in urls.judge(df, [], nothing).collect()} == {"allow"}


def test_long_lists_are_dealt_into_groups(spark, monkeypatch):
    monkeypatch.setattr(urls, "MAX_KEYS", 500)
    pages = spark.range(6000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id") % 3000, F.lit(".net/x")).alias("url"))
    listed = spark.range(0, 9000, 2).select(F.concat(F.lit("h"), "id", F.lit(".net")).alias("host"))
    got = urls.judge(pages, [("allow", "h4.net", "/")], listed)
    assert got.count() == 6000
    wrong = got.withColumn("k", F.col("page_id") % 3000).filter((F.col("verdict") == "block") != ((F.col("k") % 2 == 0) & (F.col("k") != 4)))
    assert wrong.count() == 0
    hosts = spark.range(3000).select(F.col("id").cast("string").alias("key"), (F.col("id") % 2 == 0).alias("listed"))
    assert urls.group_count(hosts) == 3 and urls.group_count(hosts.limit(0)) == 1


def test_cascade_is_exact_and_deep(spark, monkeypatch):
    monkeypatch.setattr(urls, "MIN_BITS", 64)
    monkeypatch.setattr(urls, "BITS_PER_KEY", 2)
    keys = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 5 == 0).alias("listed"))
    cascade = urls.Cascade.build(keys)
    assert len(cascade.levels) >= 3
    assert keys.filter(cascade.contains(F.col("key")) != F.col("listed")).count() == 0


def test_url_query_plan_has_no_python_and_no_join(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    plan = urls.judge(df, queries.URL_RULES, spark.createDataFrame([("a.net",)], "host string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Join" not in plan


# op 4 and 8 -------------------------------------------------------------------------------------------------


def tricky(rng, n):
    alphabet = "aeiou thnrs'.,!?\n0123é<|endoftext>_-中🙂\t  \x1c\x85½"
    return EDGES + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 70))) for _ in range(n)] + ["don't we're I'LL", "a" * 600, "  \n \n", "x<|endoftext|>y"]


def test_trie_encodes_as_the_library_does(spark, tokenizer):
    texts = tricky(random.Random(7), 1500)
    rows = encoding.round_trip(frame(spark, texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = encoding.decode(encoding.encode(frame(spark, texts))).collect()
    assert all(r.text == (texts[r.doc_id] or "") for r in back)


def test_edits_keep_the_counts_true(tokenizer):
    rng, v = random.Random(8), bpe.vocabulary()
    count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    for text in tricky(rng, 60) + [prose(rng, 800), "<|endoftext|>x" * 60, "don't " * 300]:
        text = text or ""
        pieces = v.pieces(text)
        v.prepare([pieces])
        tree = edits.Tree.of(pieces, v.cache)
        leaves = tree.cut(text)
        for _ in range(5):
            at = rng.randint(0, len(text))
            removed, more = min(rng.choice([0, 1, 6, 90]), len(text) - at), rng.choice(["", "'", "re", "  ", "<|endof", "text|>", "x y", "\n\n", "é", "many words " * 90])
            edits.edit(leaves, tree, at, removed, more, v)
            text = text[:at] + more + text[at + removed :]
            assert "".join(leaves) == text and leaves == tree.cut(text)
            assert (tree.tokens[1], tree.chars[1]) == (count(text), len(text))


def test_many_edits_cost_as_little_as_the_first(tokenizer):
    rng, v = random.Random(41), bpe.vocabulary()
    text = prose(rng, 4000)
    pieces = v.pieces(text)
    v.prepare([pieces])
    tree = edits.Tree.of(pieces, v.cache)
    leaves, most = tree.cut(text), 0
    for k in range(600):
        at = (len(text), len(text) // 2, 0)[k % 3]
        more = f" {prose(rng, 3)} x{k}"
        most = max(most, edits.edit(leaves, tree, at, 0, more, v))
        text = text[:at] + more + text[at:]
    for _ in range(300):
        most = max(most, edits.edit(leaves, tree, len(text) // 2, 30, "", v))
        text = text[: len(text) // 2] + text[len(text) // 2 + 30 :]
    assert "".join(leaves) == text and tree.tokens[1] == len(tokenizer.encode(text, add_special_tokens=False).ids)
    assert most <= 5 * edits.LEAF


def test_edit_query_counts_and_saves_work(spark, tokenizer):
    rng = random.Random(9)
    texts = tricky(rng, 40) + [prose(rng, 3000)]
    docs = frame(spark, texts).withColumn("edits", edits.sample_edits())
    plan = {r.doc_id: r.edits for r in docs.collect()}
    for r in edits.apply_edits(edits.build(docs)).collect():
        new = texts[r.doc_id] or ""
        n = len(new)
        for e in sorted(plan[r.doc_id], key=lambda e: e["at"])[::-1]:
            a = min(e["at"], n)
            new = new[:a] + e["inserted"] + new[a + min(e["removed"], n - a) :]
        assert r.text == new and r.edited_tokens == len(tokenizer.encode(new, add_special_tokens=False).ids)
        assert r.n_tokens == len(tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids)
    assert r.recoded_pieces < r.n_pieces / 4


# op 5 -------------------------------------------------------------------------------------------------------


def test_packing_places_each_id_once(spark, tokenizer, monkeypatch):
    rng = random.Random(10)
    texts = EDGES + [prose(rng, rng.randrange(1, 900)) for _ in range(150)] + ["same text again"] * 40 + [prose(rng, 5000)]
    monkeypatch.setattr(packing, "SHARD_TOKENS", 20_000)
    rows = packing.packed(frame(spark, texts).coalesce(2)).collect()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(range(len(texts)))
    for doc, ps in pieces.items():
        ids = np.array([*tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= 1024 and at & (at - 1) == 0  # no padding
    assert packing.packed(frame(spark, [])).count() == 0


def test_fast_ids_split_and_encode_as_the_library_does(tokenizer, monkeypatch):
    rng = random.Random(43)
    parts = ["'s", "'t", "'re", "'ll", "'ve", "'m", "'d", "'", "''", " ", "  ", "\n", "\t ", " \n", "word", "S", "é", "ÀÖ", "12", "3", "-", "!?", "r", "e", "l", "_", "\x0b", "re", "ve"]
    texts = ["", " ", "a", "'s", " 's", "it's", "x'", "'sat", "\n'll", "don't we're I'LL  you'd"] + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(6000)]
    data, offsets = bytewise.utf8(pa.array(texts))
    starts = fastids.borders(data, offsets)
    raw, edges = data.tobytes(), [*starts.tolist(), len(data)]
    got = [raw[a:b].decode() for a, b in itertools.pairwise(edges)]
    assert got == [w for t in texts for w in bpe._PLAIN.findall(t)]
    for slots in (1 << 21, 64):  # the smaller table is soon full
        monkeypatch.setattr(fastids, "SLOTS", slots)
        ids = packing.Ids(bpe.DEFAULT, packing.public_tokenizers.path("byte_bpe_50k.tiktoken"))
        for some in (texts[:3000], texts[3000:], EDGES[1:] + texts[:50], [""], []):
            want = [[*e.ids, packing.SEPARATOR] for e in tokenizer.encode_batch(some, add_special_tokens=False)]
            assert [x.tolist() for x in ids.all(some)] == want


def test_bm25_ranks_as_the_formula_does():
    rng = np.random.default_rng(11)
    docs = [rng.integers(0, 60, rng.integers(5, 60)).astype("<u4") for _ in range(40)]
    index, n = packing.Index(docs), len(docs)
    mean = np.mean([len(d) for d in docs])
    df = Counter(t for d in docs for t in set(d.tolist()))

    def weight(d, t):
        tf, idf = (docs[d] == t).sum(), np.log1p((n - df[t] + 0.5) / (df[t] + 0.5))
        return idf * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(docs[d]) / mean))

    for seed in range(n):
        terms = sorted((t for t in set(docs[seed].tolist()) if df[t] > 1), key=lambda t: -weight(seed, t))
        terms, rest = terms[: packing.QUERY_TERMS], terms[packing.QUERY_TERMS :]
        if rest and abs(weight(seed, terms[-1]) - weight(seed, rest[0])) < 1e-12:
            continue  # a tie at the border
        score = {d: sum(weight(d, t) for t in terms) for d in range(n) if d != seed}
        unused = np.ones(n, bool)
        unused[seed] = False
        got = index.ranked(seed, unused).tolist()
        assert set(got) == {d for d, s in score.items() if s > 0}
        assert all(score[a] >= score[b] - 1e-9 for a, b in itertools.pairwise(got))


def test_bm25_ranks_by_all_terms(monkeypatch):
    rng = np.random.default_rng(33)
    docs = [rng.integers(0, 300, rng.integers(40, 160)).astype("<u4") for _ in range(40)]
    df = Counter(t for d in docs for t in set(d.tolist()))
    corpus = packing.Corpus(100, 90.0, np.array([2 * df[t] for t in range(300)]))
    tf = [Counter(d.tolist()) for d in docs]

    def weight(d, t):
        return np.log1p((100 - 2 * df[t] + 0.5) / (2 * df[t] + 0.5)) * tf[d][t] * (packing.K1 + 1) / (tf[d][t] + packing.K1 * (1 - packing.B + packing.B * len(docs[d]) / 90))

    for most in (packing.PRODUCT, 0):
        monkeypatch.setattr(packing, "PRODUCT", most)
        index = packing.Index(docs, corpus)
        for seed in range(len(docs)):
            score = [sum(weight(d, t) for t in tf[seed] if t in tf[d]) for d in range(len(docs))]
            unused = np.ones(len(docs), bool)
            unused[seed] = False
            got = index.ranked(seed, unused).tolist()
            assert set(got) == {d for d in range(len(docs)) if d != seed and score[d] > 0}
            assert all(score[a] >= score[b] - 1e-9 for a, b in itertools.pairwise(got))


def test_packing_finds_neighbours_in_other_partitions(spark, monkeypatch):
    """Documents of 30 subjects, each dealt over all partitions: windows must hold documents of one subject, and copies meet."""
    rng = random.Random(31)
    vocab = [["".join(rng.choice("aeioustrnl") for _ in range(7)) for _ in range(12)] for _ in range(30)]
    texts = [" ".join(rng.choice(vocab[k]) for _ in range(60)) for _ in range(12) for k in range(30)]
    monkeypatch.setattr(packing, "SHARD_TOKENS", 20_000)

    def alike(parts):
        rows = packing.packed(frame(spark, texts).repartitionByRange(parts, "doc_id"), window=512).collect()
        assert sorted({r.doc_id for r in rows}) == list(range(len(texts)))
        by = {}
        for r in rows:
            by.setdefault(r.sequence_id, set()).add(r.doc_id)
        pairs = [(a % 30) == (b % 30) for ds in by.values() for a, b in itertools.combinations(sorted(ds), 2)]
        return sum(pairs) / len(pairs)

    assert alike(12) > 0.3 and alike(1) > 0.3


def test_bm25_uses_the_counts_of_all_documents(spark):
    rng = random.Random(32)
    texts = [*EDGES, *(prose(rng, rng.randrange(1, 80)) for _ in range(60))]
    tokens = packing._tokens(frame(spark, texts).repartition(5), bpe.DEFAULT, packing.public_tokenizers.path("byte_bpe_50k.tiktoken"))
    corpus = packing._corpus(tokens)
    docs = [packing._array(r.ids) for r in tokens.collect() if r.ids is not None]
    df = Counter(t for d in docs for t in set(d.tolist()))
    assert corpus.n == len(texts) and corpus.mean == sum(map(len, docs)) / len(docs)
    assert {t: int(corpus.df[t]) for t in np.flatnonzero(corpus.df).tolist()} == df
    part = docs[:10]
    index = packing.Index(part, corpus)
    t = int(part[0][0])
    seen = [(int(d), w) for d, w, k in zip(index.doc, index.weight, np.repeat(np.arange(len(index.begin)), index.end - index.begin), strict=True) if k == sorted({x for d in part for x in d.tolist()}).index(t)]
    for d, w in seen:
        assert w == pytest.approx(corpus.weights(np.array([t]), np.array([(part[d] == t).sum()]), len(part[d]))[0])


# op 6 -------------------------------------------------------------------------------------------------------


def test_turns_survive_the_round_trip():
    rng = random.Random(12)
    parts = [*chat.CONTROL, "\\", "\\\\", " ", "<", "[", "]", "s>", "ROLE x] ", "a", "é\n", " </s>", " [/INST]"]
    roles = ["user", "assistant", "system", "", "tool", "we]ird\\", "[ROLE", "a [/ROLE]"]
    for _ in range(4000):
        turns = [(rng.choice(roles), "".join(rng.choice(parts) for _ in range(rng.randrange(0, 7)))) for _ in range(3)]
        whole = "".join(chat.render(*t) for t in turns)
        assert [t[:2] for t in chat.parse(whole)] == turns
    assert chat.render("user", "plain") == "[INST] plain [/INST]"
    with pytest.raises(ValueError):
        chat.parse("[INST] open")


def test_chat_digests(spark):
    rows = [(1, 2, "assistant", "b [INST]"), (1, 1, "user", None), (None, 0, None, "x"), (2, 1, "user", "same"), (2, 1, "user", "same"), (2, 0, "assistant", "é")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, rendered string")
    got = {r.conv_id: r for r in chat.digests(chat.formatted(df)).collect()}
    for conv in (1, None, 2):
        turns = sorted((t, r or "", x or "") for c, t, r, x in rows if c == conv)
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[conv].loss_chars == len(loss) and got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[conv].formatted_chars == sum(len(chat.render(r, x)) for _, r, x in turns)
    x = chat.formatted(df).filter("role = 'assistant'").collect()
    assert all(chat.unescape(r.rendered[r.loss_start : r.loss_end]) == r.text for r in x)
    assert chat.digests(chat.formatted(df.limit(0))).count() == 0


# op 7 -------------------------------------------------------------------------------------------------------


def test_toxicity_learns_words_it_was_not_given(spark):
    rng = random.Random(13)
    texts, toxic = [], []
    for i in range(500):
        words = prose(rng, 60).split()
        bad = i % 6 == 0
        if bad:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(["zorbel", "krumpfen", "krumpfig", "krumpfo"])
        texts.append(" ".join(words) + ".")
        toxic.append(int(bad))
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, y, 1) for i, y in enumerate(toxic)] + [(1, None, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(docs, labels.filter(~toxicity.held_out()))
    rows = toxicity.score(docs, model).withColumn("held", toxicity.held_out()).collect()
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    right = [(r.score >= 0.5) == bool(toxic[r.doc_id]) for r in rows if r.held]
    assert sum(right) / len(right) > 0.95


def scored(text, model=None):
    model = model or toxicity.Model()
    constant, *slopes = model.coefficients
    return constant + sum(c * x for c, x in zip(slopes, toxicity.Grammar(model).document(text), strict=True))


def test_grammar_weighs_clauses():
    plain = scored("you are an idiot")
    assert plain > scored("he is not an idiot") and plain > scored("she said: you are an idiot") and plain > scored("an idiot")
    assert scored("i will kill you") > scored("the kill was quick")
    assert scored("du wirst ihn töten") > scored("du wirst ihn töten nicht") and scored("töten wirst du ihn") >= scored("töten wirst du ihn nicht")
    assert scored("what a waste of space") > scored("what a waste of good space") == scored("")
    assert toxicity.Grammar(toxicity.Model()).document("") == (0.0,) * 7


def plain_clause(model, words, reported):
    """The grammar's rules word by word, by looking around each."""
    neg, after = set(toxicity.NEGATION), set(toxicity.AFTER)
    said = any(w in toxicity.REPORTED for w in words)
    aimed = any(w in toxicity.TARGET for w in words)
    out = [0.0] * 6
    for i, w in enumerate(words):
        gains = [(0, model.weight(w))]
        if any(words[max(0, i + 1 - len(p.split())) : i + 1] == p.split() for p in toxicity.PHRASES):
            gains[0] = (0, gains[0][1] + toxicity.PHRASE)
        rest = [k for k, v in enumerate(words[: i + 1]) if v not in neg]  # what the threat counts
        wills = [rest.index(k) for k in rest if words[k] in toxicity.INTENT]
        if w in toxicity.HARM and w not in neg and wills and rest.index(i) - wills[-1] <= toxicity.WINDOW:
            gains.append((2, toxicity.HARMING))
        before = [i - 1 - k for k in range(i) if words[k] in neg]
        behind = [k - i - 1 for k in range(i + 1, len(words)) if words[k] in after]
        negated = w not in neg and (before and before[-1] <= toxicity.NEAR) or w not in after and (behind and behind[0] <= toxicity.NEAR)
        for base, gain in gains:
            out[4 if reported or said else base + bool(negated)] += gain
    if aimed and not (reported or said):
        out[5] = out[0] + out[2]
    return out, said


def test_composed_machine_follows_the_rules():
    rng = random.Random(21)
    model = toxicity.Model()
    g = toxicity.Grammar(model)
    pool = ["word", "thing", "idiot", "scum", "kill", "hurt", "will", "must", "you", "they", "not", "nicht", "never", "pas", "said", "says", "piece", "of", "trash", "waste", "space", "go", "to", "hell"]
    for _ in range(6000):
        words, reported = [rng.choice(pool) for _ in range(rng.randrange(1, 14))], rng.random() < 0.3
        score, said = g.clause(words, reported)
        want, want_said = plain_clause(model, words, reported)
        assert said == want_said and score == pytest.approx(want), (words, reported)


def test_same_model_however_rows_are_dealt(spark):
    rng = random.Random(35)
    rows = [(prose(rng, 40, 300) + rng.choice([" krumpfen ", " krumpfig "] if i % 4 == 0 else [" ", " ", " krumpfen "] if i % 9 == 0 else [" "]) + prose(rng, 9, 300), int(i % 4 == 0)) for i in range(300)]
    rows += rows[:40] * 3
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    docs = frame(spark, [t for t, _ in rows])
    one = toxicity.fit(docs.coalesce(1), labels)
    assert one == toxicity.fit(docs.repartition(37), labels.repartition(3)) and one.purity in toxicity.PURITIES
    assert len({(r.score) for r in toxicity.score(docs.limit(3), one).collect()}) >= 1


def test_finder_misses_no_document_with_a_score(spark):
    rng = random.Random(14)
    model = toxicity.Model(beginnings={"krum": 2.0, "éäöü": 1.5})
    texts = EDGES + [prose(rng, 30) + rng.choice([" Krumpf!", " ÉÄÖÜx", " IDIOT", " no", "'idiot'"]) for _ in range(200)]
    got = {r.doc_id: tuple(r.features) for r in toxicity.features(frame(spark, texts), model).collect()}
    g = toxicity.Grammar(model)
    for i, t in enumerate(texts):
        assert got[i] == g.document((t or "").lower())


def test_copies_count_once_for_the_lexicon(spark):
    rng = random.Random(34)
    copies = [(prose(rng, 30, 60) + " glarbon", 1)] * 1000
    rows = [*copies, *((prose(rng, 30, 60) + " krumpfen", 1) for _ in range(5)), *((prose(rng, 30, 60), 0) for _ in range(200))]
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    docs = frame(spark, [t for t, _ in rows])
    for parts in (1, 8):
        words = toxicity.fit(docs.repartition(parts), labels).words
        assert "krumpfen" in words and "glarbon" not in words


def test_finder_splits_words_as_the_grammar_does(spark):
    model = toxicity.Model(words={**toxicity.Model().words, "d'abruti": 2.0}, beginnings={"l'im": 2.0, "zorb": 1.5, "éäöü": 1.5})
    marks = [*"¡¿“”«»…—–’‘、。•€£©°", "\u00a0", "\u2003", "\u0301", "\u0663", "\u200b", "ª", "²", "é", "_", "7", "'", "x'", "'x'", "''"]
    words = ["idiota", "trash", "idiot", "moron", "abruti", "d'abruti", "l'imposteur", "zorbel", "ÉÄÖÜx", "arschloch"]
    texts = [f"so {a}{w}{b} it" for w in words for a in marks for b in ("", *marks)] + ["¡idiota!", "“trash”", "moron—really", "«\u00a0abruti\u00a0»"]
    got = {r.doc_id: tuple(r.features) for r in toxicity.features(frame(spark, texts), model).collect()}
    g = toxicity.Grammar(model)
    for i, t in enumerate(texts):
        assert got[i] == g.document(t.lower()), t
    assert all(sum(got[i]) > 0 for i in range(len(texts) - 4, len(texts)))


def test_toxicity_without_labels_scores_all(spark):
    docs = frame(spark, EDGES)
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    scores = [r.score for r in toxicity.score(docs, toxicity.fit(docs, empty)).collect()]
    assert len(scores) == len(EDGES) and all(0 <= s < 0.5 for s in scores)


def test_filters_keep_columns_with_any_names(spark):
    rng = random.Random(20)
    docs = frame(spark, EDGES + [prose(rng, 90) for _ in range(60)] + ["you are a stupid worthless idiot. " * 4]).withColumns({"n_words": F.lit("mine"), "x0": F.lit(1.5), "total": F.lit(7), "carried": F.lit("c")})
    a = toxicity.below(docs, toxicity.Model())
    b = quality.kept(docs)
    assert a.dtypes == docs.dtypes == b.dtypes
    want = {r.doc_id for r in toxicity.score(docs, toxicity.Model()).collect() if r.score < 0.5}
    assert {r.doc_id for r in a.collect()} == want and len(EDGES) + 60 not in want
    rows = b.collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in quality.quality(docs).collect() if r.kept}
    assert all((r.n_words, r.x0, r.total, r.carried, r.node) == ("mine", 1.5, 7, "c", 1) for r in rows)


# op 9 -------------------------------------------------------------------------------------------------------


def test_fingerprints_of_edits_and_next(spark):
    rng = random.Random(15)
    texts = EDGES + [prose(rng, 20, 6) for _ in range(80)] + ["Straße  ONE", "STRASSE one", "ﬁne", "fine"]
    ids = [3 * i - 5 for i in range(len(texts))]
    got = {r.doc_id: r for r in fingerprints.against_edits(frame(spark, texts, ids).repartition(3)).collect()}
    own = fingerprints.canonical
    for k, i in enumerate(ids):
        text, following = texts[k] or "", texts[(k + 1) % len(texts)] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + following[:half]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprints.fingerprint(own(text)), fingerprints.fingerprint(own(new)))
        assert r.near_edited == float(own(text) == own(new)) and r.near_next == float(own(text) == own(following))
    assert got[ids[-4]].fingerprint == got[ids[-3]].fingerprint and got[ids[-2]].fingerprint == got[ids[-1]].fingerprint


def test_colliding_fingerprints_are_told_apart(spark, monkeypatch):
    texts = ["alpha", "ALPHA ", "beta", "gamma", None]
    docs = frame(spark, texts)
    short = lambda content: "0" * 32 if content in (b"alpha", b"beta") else "f" * 32
    import pyspark.cloudpickle as cp

    monkeypatch.setattr(fingerprints, "fingerprint", short)
    cp.register_pickle_by_value(fingerprints)
    try:
        got = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(docs).collect()}
    finally:
        cp.unregister_pickle_by_value(fingerprints)
    assert got[0] == got[1] != got[2] and len({got[0], got[2], got[3], got[4]}) == 4


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    """Beyond the most bits, shared texts meet by a join, and collisions are found all the same."""
    texts = [f"text {i % 30}" for i in range(90)] + [f"alone {i}" for i in range(20)]
    docs = frame(spark, texts)
    want = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(docs).collect()}
    monkeypatch.setattr(fingerprints, "LEAST_FILTER", 64)
    monkeypatch.setattr(fingerprints, "MOST_FILTER", 64)
    assert {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(docs).collect()} == want
    assert all(want[i] == fingerprints.fingerprint(t.encode()) for i, t in enumerate(texts))


def test_fingerprint_edge_tables(spark):
    assert fingerprints.against_edits(frame(spark, [])).count() == 0
    one = fingerprints.against_edits(frame(spark, ["abcd"])).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one[0].near_next == 1.0
    rows = fingerprints.against_edits(frame(spark, ["ab", "cd", "cd"], [None, 7, 7])).collect()
    assert sorted((r.doc_id is None, r.n_chars) for r in rows) == [(False, 2), (False, 2), (True, 2)]


# op 10 ------------------------------------------------------------------------------------------------------


def shingles(text, k):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def components(sets):
    root = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                ra, rb = root[a], root[b]
                root = [min(ra, rb) if r in (ra, rb) else r for r in root]
    return root


def family(rng, n, edits_each):
    base = prose(rng, 120).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits_each + 1)):
            w[rng.randrange(len(w))] = prose(rng, 1)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_match_all_pairs(spark, k):
    rng = random.Random(16)
    passage = prose(rng, 60)
    texts = EDGES + ["A  b c", "a b\nC"] + family(rng, 60, 9) + family(rng, 40, 3) + [prose(rng, 40) + " " + passage + " " + prose(rng, 30) for _ in range(60)] + ["tiny text here now ok"] * 5 + ["tiny text here now ok yes"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    docs = frame(spark, [texts[i] for i in order], order)
    sets = [shingles(t, k) for t in texts]
    want = components(sets)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, k).collect()}
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert got[i].n_shingles == len(sets[i]) and got[i].component_id == want[i], texts[i]


@pytest.mark.parametrize(("common", "large", "peels"), [(2, 3, 3), (0, 2, 6)])
def test_remainder_finds_all_links_without_buckets(spark, monkeypatch, common, large, peels):
    """From no components at all: families around common texts, chains, different lengths; with limits so small that groups go round again."""
    rng = random.Random(17)
    texts = family(rng, 45, 9) + family(rng, 25, 3) + [prose(rng, 60) for _ in range(5)]
    chain = prose(rng, 90).split()
    texts += [" ".join(chain[i : i + 70]) for i in range(0, 20, 2)]
    texts = list(dict.fromkeys(texts))
    sets = [shingles(t, 4) for t in texts]
    hashed = [[hash(x) for x in s] for s in sets]
    for name, value in (("COMMON", common), ("LARGE", large), ("PEELS", peels)):
        monkeypatch.setattr(minhash, name, value)
    nodes = spark.createDataFrame([(i, i, len(s)) for i, s in enumerate(sets)], "node long, root long, n long")
    alone = spark.createDataFrame([], "node long, root long")
    with Scratch(spark) as scratch:
        rows = minhash._remainder(nodes, spark.createDataFrame(list(enumerate(hashed)), "node long, hashes array<long>"), alone, 80, scratch).collect()
    got = {r.node: r.root for r in rows}
    assert [got.get(i, i) for i in range(len(sets))] == components(sets)


def test_peeling_gives_few_candidates(spark, monkeypatch):
    """Variants of one text that are not similar enough: next to no pair is looked at, though all share most of their shingles."""
    rng = random.Random(18)
    base = prose(rng, 150).split()
    texts = []
    for _ in range(160):
        w = list(base)
        for i in rng.sample(range(150), 5):
            w[i] = prose(rng, 1) + "x"
        texts.append(" ".join(w))
    sets = [shingles(t, 4) for t in texts]
    hashed = [[hash(x) for x in s] for s in sets]
    looked = []
    confirmed = minhash._confirmed
    monkeypatch.setattr(minhash, "_confirmed", lambda edges, *a: looked.append(edges.count()) or confirmed(edges, *a))
    nodes = spark.createDataFrame([(i, i, len(s)) for i, s in enumerate(sets)], "node long, root long, n long")
    with Scratch(spark) as scratch:
        got = minhash._remainder(nodes, spark.createDataFrame(list(enumerate(hashed)), "node long, hashes array<long>"), spark.createDataFrame([], "node long, root long"), 80, scratch)
        rows = {r.node: r.root for r in got.collect()}
    assert [rows.get(i, i) for i in range(len(sets))] == components(sets)
    assert looked[-1] < len(texts)


def test_hubs_are_dealt_into_parts(spark, monkeypatch):
    monkeypatch.setattr(minhash, "HUB", 3)
    sets = spark.createDataFrame([(i, list(range(10 + i % 4))) for i in range(20)], "node long, hashes array<long>")
    edges = spark.createDataFrame([(i, 0) for i in range(1, 20)] + [(5, 4)], "a long, b long")
    got = sorted(map(tuple, minhash._confirmed(edges, sets, 80).collect()))
    assert got == sorted([(i, 0) for i in range(1, 20) if i % 4 < 3] + [(5, 4)])


def test_sets_come_by_filter_or_by_join(spark, monkeypatch):
    docs = frame(spark, [prose(random.Random(i), 30) for i in range(50)]).select("doc_id", "text")
    nodes = spark.range(0, 50, 7).withColumnRenamed("id", "node")
    few = {r.node: sorted(r.hashes) for r in minhash._full_sets(docs, nodes, 4).collect()}
    monkeypatch.setattr(minhash, "MAX_FILTER", 16)
    joined = {r.node: sorted(r.hashes) for r in minhash._full_sets(docs, nodes, 4).collect()}
    assert joined == {i: few[i] for i in range(0, 50, 7)} and len(few) < 50


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, x) for x in range(101, 120)] + [(7, 7)]
    with Scratch(spark) as scratch:
        got = {r.node: r.root for r in minhash.components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    assert {got[i] for i in range(1, 41)} == {1} and {got[i] for i in range(100, 120)} == {100}


def test_a_hub_meets_its_edges_in_parts(spark):
    """However many edges a node has, none of the parts it is dealt into has more than its share."""
    edges = spark.range(1, 3201).select(F.lit(0).cast("long").alias("b"), F.col("id").alias("a"))
    joined, whole = minhash._per_key(edges, "b", "a")
    assert whole.select("b", "least", "n").collect() == [(0, 1, 3200)] and len(whole.first().salts) == minhash.SALTS
    assert {(r.least, r.n) for r in joined.collect()} == {(1, 3200)} and joined.count() == 3200


def test_repeated_ids_give_one_answer(spark):
    rng = random.Random(23)
    base = prose(rng, 80)
    texts = [base, base + " end", prose(rng, 50), prose(rng, 50), base, None]
    ids = [4, 9, 9, 9, 2, None]
    first = sorted(map(tuple, minhash.near_duplicates(frame(spark, texts, ids)).collect()), key=str)
    again = sorted(map(tuple, minhash.near_duplicates(frame(spark, texts[::-1], ids[::-1]).repartition(3)).collect()), key=str)
    assert first == again and len(first) == 6
    assert {c for d, _, c in first if d in (2, 4)} == {2}


def test_repeated_and_missing_ids_lose_no_link(spark, monkeypatch):
    """Each row is linked by its own text, whoever shares its id; a component is named by its least id, and one without ids by none."""
    rng = random.Random(29)
    texts, ids = [], []
    for f in range(12):
        texts += family(rng, 6, 6)
        ids += [rng.choice([None, 5 * f, 5 * f + 1, rng.randrange(60)]) for _ in range(6)]
    texts += family(rng, 3, 1) + [prose(rng, 40), None]
    ids += [None, None, None, 3, 3]
    sets = [shingles(t, 5) for t in texts]
    root = components(sets)  # by row
    least = {}
    for k, r in enumerate(root):
        if ids[k] is not None:
            least[r] = min(ids[k], least.get(r, ids[k]))
    want = sorted(((ids[k], len(sets[k]), least.get(r)) for k, r in enumerate(root)), key=str)
    for most in (minhash.MAX_FILTER, 16):
        monkeypatch.setattr(minhash, "MAX_FILTER", most)
        assert sorted(map(tuple, minhash.near_duplicates(frame(spark, texts, ids).repartition(3)).collect()), key=str) == want
    b, c = prose(rng, 60), prose(rng, 60)
    for a in ("a b c", c, "x " + b, b[:90], prose(rng, 9)):
        got = sorted(map(tuple, minhash.near_duplicates(frame(spark, [a, b, b + " end", b], [1, 1, 2, 3])).select("doc_id", "component_id").collect()))
        assert got.count((2, 1)) == got.count((3, 1)) == 1


def test_near_duplicate_edge_tables(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    rows = {(r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(spark, [None, "", " "])).collect()}
    assert rows == {(0, 0, 0), (1, 0, 1), (2, 0, 2)}
