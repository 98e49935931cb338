"""Registered text queries: equal to their SQL where there is some; the pipeline's stages against plain versions."""

import hashlib
import os
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_there_is_one_query_for_each_operator():
    from paceline.llm import queries

    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}


@pytest.mark.parametrize("name", ["op3_url_bloom_cascade", "op6_chat_round_trip", "op10_minhash_near_dedup"])
def test_query_equals_sql(spark, name):
    from paceline.llm import queries

    db = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    r = db.sql(queries.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(r.columns)
    want = [tuple(row[list(r.columns).index(c)] for c in columns) for row in r.fetchall()]
    assert sorted(map(str, (tuple(x[c] for c in columns) for x in df.collect()))) == sorted(map(str, want))


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline
    from paceline.llm import minhash, pii, quality, toxicity
    from paceline.llm.store import materialize, table

    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "pii", "packing"]
    docs = table(spark, SF, "documents")
    columns = docs.columns
    labels = table(spark, SF, "labels").filter(~toxicity.held_out())
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    a = materialize(pipeline.drop_toxic(spark, docs, SF), "t")
    assert a.columns == columns and {r.doc_id for r in a.collect()} == {d for d, s in scores.items() if s < 0.5}
    b = materialize(pipeline.keep_quality(spark, a, SF), "t")
    assert b.columns == columns and {r.doc_id for r in b.collect()} == {r.doc_id for r in quality.quality(a).collect() if r.kept}
    c = materialize(pipeline.drop_near_duplicates(spark, b, SF), "t")
    assert c.columns == columns and {r.doc_id for r in c.collect()} == {r.component_id for r in minhash.near_duplicates(b, 5).collect()}
    d = materialize(pipeline.redact_personal_data(spark, c, SF), "t")
    texts, model = {r.doc_id: r.text for r in c.collect()}, pii.fit(c)
    assert d.columns == columns and all(r.text == pii.replaced(texts[r.doc_id], pii.spans_of(texts[r.doc_id], model)) and r.n_chars == len(r.text) for r in d.collect())
    pieces = pipeline.pack(spark, d, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in d.collect()}
    assert pipeline.run(spark, SF).count() == pieces.count()


# registered queries against plain versions of what their contracts say --------------------------------------


@pytest.fixture(scope="module")
def texts():
    """doc_id and text of the documents, in order."""
    return [(d, t or "") for d, t in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()]


@pytest.fixture(scope="module")
def library():
    from paceline.llm import bpe

    tokenizer = Tokenizer.from_file(bpe.DEFAULT)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids, lambda ids: tokenizer.decode(ids, skip_special_tokens=False)


def by_doc(spark, name):
    from paceline.llm import queries

    rows = queries.QUERIES[name](spark, SF).collect()
    found = {r.doc_id: r for r in rows}
    assert len(found) == len(rows)
    return found


def test_op1_base_of_all_documents(spark, texts):
    got = by_doc(spark, "op1_mcd_quality")
    assert set(got) == {d for d, _ in texts}
    for d, text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines, seen, repeated = text.split("\n"), set(), 0
        for line in lines:
            if re.search(r"[^\x20\x09-\x0D]", line):
                repeated += line in seen
                seen.add(line)
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        often = {w for w, n in Counter(windows).items() if n > 1}
        inside = {j for i, w in enumerate(windows) if w in often for j in range(i, i + 8)}
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), repeated, len(inside))
        assert r.base_failed == (len(words) < 20 or 100 * len(inside) > 30 * len(words)) and not (r.base_failed and r.kept)


def test_op2_base_of_all_documents(spark, texts):
    got = by_doc(spark, "op2_weak_supervision_pii")
    assert set(got) == {d for d, _ in texts}
    digits = lambda s: re.sub("[^0-9]", "", s)
    doubled = lambda s: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(s[::-1]))
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and doubled(digits(s)) % 10 == 0),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    }
    some = 0
    for d, text in texts:
        spans = [(m.start(), place, f"{kind}:{m.start()}:{m.end()}", kind) for place, (kind, (pattern, good)) in enumerate(rules.items()) for m in re.finditer(pattern, text) if good(m[0])]
        base, r = [s for _, _, s, _ in sorted(spans)], got[d]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for *_, k in spans) for kind in rules]
        assert set(base) <= set(r.spans.split(","))
        some += bool(base)
    assert some


def test_op4_counts_of_all_documents(spark, texts, library):
    encode, _ = library
    got = by_doc(spark, "op4_edit_token_counts")
    for d, text in texts:
        n = len(text)
        new = text
        for at, removed, inserted in ((n + 9, 0, " (end)"), (n // 2 + 9, 40, ""), (n // 3, 9, text[:12]), (0, 0, "Draft: ")):
            at = min(at, n)
            new = new[:at] + inserted + new[min(at + removed, n) :]
        assert (got[d].n_tokens, got[d].edited_tokens) == (len(encode(text)), len(encode(new)))


def test_op5_pieces_of_all_documents(spark, texts, library):
    from paceline.llm import queries

    encode, _ = library
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in queries.QUERIES["op5_bm25_packing"](spark, SF).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == {d for d, _ in texts}
    for d, text in texts:
        ids, at = np.array([*encode(text), 0], "<u4"), 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    padding = total = 0
    for spans in sequences.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end and length > 0
            end += length
        assert end <= 1024
        total += end
        padding += 0 if end & (end - 1) == 0 else 1024 - end
    assert padding <= 0.05 * total


def test_op7_scores_all_documents_and_no_label_of_theirs(spark, texts, tmp_path):
    from paceline.llm import queries

    got = by_doc(spark, "op7_toxicity_grammar")
    assert set(got) == {d for d, _ in texts}
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    # held-out labels turned round, other columns mixed: nothing changes
    for t in ("documents", "labels"):
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        if t == "labels":
            df = df.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")).cast(dict(df.dtypes)["toxic"]))
        else:
            df = df.withColumns({"lang": F.lit("xx"), "source": F.lit("y")})
        df.write.parquet(str(tmp_path / f"{t}.parquet"))
    again = {r.doc_id: r.score for r in queries.QUERIES["op7_toxicity_grammar"](spark, str(tmp_path)).collect()}
    assert again == {d: r.score for d, r in got.items()}


def test_op8_round_trip_of_all_documents(spark, texts, library):
    encode, decode = library
    got = by_doc(spark, "op8_trie_bpe")
    assert set(got) == {d for d, _ in texts}
    for d, text in texts:
        ids = encode(text)
        assert got[d].n_tokens == len(ids) and got[d].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[d].decoded_sha256 == hashlib.sha256(decode(ids).encode()).hexdigest()


def test_op9_of_all_documents(spark, texts):
    got = by_doc(spark, "op9_exact_digest")
    assert set(got) == {d for d, _ in texts}
    plain = lambda t: " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold()).split())
    prints = {}
    for k, (d, text) in enumerate(texts):
        following, half, r = texts[(k + 1) % len(texts)][1], len(text) // 2, got[d]
        new = text[: len(text) - half] + following[:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert (r.near_edited, r.near_next) == (float(plain(text) == plain(new)), float(plain(text) == plain(following)))
        for content, found in ((plain(text), r.fingerprint), (plain(new), r.edited_fingerprint)):
            assert prints.setdefault(content, found) == found
    assert len(set(prints.values())) == len(prints)
