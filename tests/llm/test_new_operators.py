"""Cross-tokenizer alignment, periodic runs and line dedup against plain versions of their rules."""
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from partweave.llm import line_dedup, periodic_runs, queries, token_align

SMALL = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def texts_of(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11
def plain_alignment(rows):
    lib, model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    lib.encode_special_tokens = True
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    bytes_a = lambda i: bytes(letters[c] for c in lib.id_to_token(i))
    bytes_b = lambda i: bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
    links, out = {}, {}
    for key, text in rows:
        links[key], out[key] = [], (0, 0, 0, "")
        if not text:
            continue
        a, b = lib.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
        if not b"".join(map(bytes_a, a)) == b"".join(map(bytes_b, b)) == (" " + text).encode():
            continue
        ends = lambda ids, one: np.cumsum([len(one(i)) for i in ids]).tolist()
        ends_a, ends_b = ends(a, bytes_a), ends(b, bytes_b)
        groups, i, j = [], 0, 0
        for e in sorted(set(ends_a) & set(ends_b)):
            x, y = ends_a.index(e, i), ends_b.index(e, j)
            links[key].append((a[x], b[y]))
            groups.append(",".join(map(str, a[i:x + 1])) + "|" + ",".join(map(str, b[j:y + 1])))
            i, j = x + 1, y + 1
        out[key] = (len(a), len(b), len(groups), sha(";".join(groups)))
    count = Counter(p for ps in links.values() for p in ps)
    best = defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return {k: (*out[k][:3], len(links[k]), sum(count[p] == best[p[1]] for p in links[k]), sum(count[p] for p in links[k]), out[k][3]) for k in out}, count


def test_alignment(spark, small, odd_documents):
    odd = [(9101, "a  b\t\tc\n\nd <|endoftext|> <s> x"), (9102, "piece ▁ mark"), (9103, " " * 5000 + "end"), (9104, "日本語 テキスト 𝒳𝒴 ﬁ naïve"),
           (9105, " leading"), (9106, "trailing  "), (9107, "\n" * 3000), (9108, "zero\0byte"), (9109, "é"), (9110, "x" * 3000)]
    docs = small.select("doc_id", "text").unionAll(odd_documents.selectExpr("doc_id + 9000", "text")).unionAll(spark.createDataFrame(odd, "doc_id long, text string"))
    want, _ = plain_alignment(texts_of(docs))
    got = {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"])
           for r in token_align.align_documents(docs, A, B).collect()}
    assert got == want
    assert want[9103][0] and want[9107][0] and want[9102] == (0, 0, 0, 0, 0, 0, "")


def test_alignment_tables(spark, small, odd_documents):
    docs = small.limit(40)
    _, count = plain_alignment(texts_of(docs))
    blocks = token_align.aligned_blocks(docs.select("doc_id", "text"), A, B)
    pairs = {(r["a_id"], r["b_id"]): r["links"] for r in token_align.token_map(blocks).collect()}
    assert pairs == count
    rows = token_align.align_documents(odd_documents.withColumnRenamed("key", "links"), A, B, with_groups=True).collect()
    assert all(sha(r["groups"]) == r["groups_sha256"] for r in rows if r["n_a"]) and len(rows) == 9
    assert token_align.align_documents(odd_documents.limit(0), A, B).count() == 0


# 12
def plain_runs(words, least=12):
    best, n = {}, len(words)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i >= p and j - i + p >= least:
                best.setdefault((i, j + p), p)
            i = j + 1 if j == i else j
    return sorted((a, b - a, p) for (a, b), p in best.items())


def planted(key, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(key).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def digest(words):
    runs = plain_runs(words)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_query(spark, small):
    want = {k: digest(planted(k, t)) for k, t in texts_of(small) if len(t or "") < 6000}
    rows = {r["doc_id"]: r for r in queries.op12_periodic_runs(spark, SMALL).collect()}
    columns = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert len(rows) == small.count() and {k: tuple(rows[k][c] for c in columns) for k in want} == want
    assert sum(v[0] > 0 for v in want.values()) > 10


def test_runs_of_any_shape():
    draw = random.Random(5)
    fibonacci = [0]
    while len(fibonacci) < 600:
        fibonacci = [x for w in fibonacci for x in ([0, 1] if w == 0 else [0])]
    for turn in range(150):
        docs = []
        for _ in range(3):
            letters, words = draw.choice([1, 2, 3, 40]), []
            while len(words) < draw.randint(0, 350):
                unit = [draw.randrange(letters) for _ in range(draw.randint(1, 70))]
                if draw.random() < 0.5:
                    unit = (unit[:draw.randint(1, 6)] * 80)[:draw.randint(4, 80)]
                words += (unit * 4)[:draw.randint(1, 3 * len(unit) + 1)]
            docs.append(words)
        docs.append(fibonacci[turn:turn + draw.randint(0, 300)])
        texts = np.concatenate([[0], np.cumsum([len(d) + 1 for d in docs])])
        flat = np.array([w for i, d in enumerate(docs) for w in [*d, 1000 + i]])
        got = [(int(b), int(e - b), int(p)) for b, e, p in periodic_runs.find_runs(flat, texts)]
        assert got == [(s + int(at), n, p) for at, d in zip(texts, docs) for s, n, p in plain_runs(d)]


def test_runs_edges(spark, odd_documents):
    docs = odd_documents.unionByName(odd_documents.limit(1).selectExpr("cast(null as long) doc_id", "repeat('a b ', 30000) text", "null source", "'x' key", "1 label", "'y' spans", "2 n_words", "'en' lang"))
    found = periodic_runs.periodic_runs(docs, runs="spans", collapsed="short")
    assert found.columns == [c for c in docs.columns if c != "spans"] + ["spans", "short"]
    rows = {r["doc_id"]: r for r in found.collect()}
    assert [tuple(s) for s in rows[None]["spans"]] == [(0, 60000, 2)] and rows[None]["short"] == "a b"
    assert rows[1]["spans"] == [] and rows[1]["text"] is None and rows[3]["short"] == "" and rows[6]["spans"] == rows[7]["spans"]
    assert periodic_runs.periodic_runs(odd_documents.limit(0)).count() == 0


# 13
def plain_lines(rows, least=10):
    strip = lambda line: line.strip(" \t\n\x0b\x0c\r")
    lower = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    holders = defaultdict(set)
    for key, text in rows:
        for line in (text or "").split("\n"):
            if key is not None and len(lower(strip(line))) >= least:
                holders[lower(strip(line))].add(key)
    out = {}
    for key, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(holders.get(lower(strip(x)), ())) < 2 or min(holders[lower(strip(x))]) == key or key is None]
        out[key] = (len(lines), len(lines) - len(stay), sha("\n".join(stay)))
    return out


def line_rows(frame):
    return {r["doc_id"]: (r["n_lines"], r["n_dropped"], sha(r["text"] or "")) for r in frame.collect()}


def test_lines(spark, small, odd_documents):
    odd = [(9101, "Same Long Line\n  same long LINE \r\n\n\nshort\n\xa0not space here\xa0"), (9102, "\tSAME long line\x0b\nshort\nÀ la carte menu"),
           (9103, "à la carte menu\n\n"), (9104, "\xa0not space here\xa0"), (9105, "once only, twice in one\nonce only, twice in one"), (9106, "\n\n"),
           (9107, "ninechars\nten chars!"), (9108, "ninechars\nten chars!"), (None, "same long line\nonce only, twice in one"), (9109, "é" * 9), (9110, "é" * 9)]
    docs = small.select("doc_id", "text").unionAll(odd_documents.selectExpr("doc_id + 9000", "text")).unionAll(
        spark.createDataFrame(odd, "doc_id long, text string")).repartition(5)
    want = plain_lines(texts_of(docs))
    assert line_rows(line_dedup.dedup_lines(docs)) == want and want[9102][1] == 1 and want[None][1] == 0
    # A filter that holds far too few bits lets more keys through and changes nothing.
    assert line_rows(line_dedup.dedup_lines(docs, per_key=1, most_bits=line_dedup.SLICE)) == want


def test_only_suspects_are_shuffled(spark, small):
    docs = small.select("doc_id", "text")
    bits = line_dedup.filter_bits(docs, 12, 1 << 28)
    twice = np.zeros(bits // 8, np.uint8)
    for r in line_dedup.second_filter(docs.repartition(4), bits, 10).collect():
        twice[r["slice"] * line_dedup.SLICE // 8:(r["slice"] + 1) * line_dedup.SLICE // 8] = np.frombuffer(r["bits"], np.uint8)
    rows = line_dedup.scan(docs, 10, bits, spark.sparkContext.broadcast(twice))
    suspects = {bytes(r["key"]) for r in rows.filter("key is not null").collect()}
    lines = defaultdict(set)
    for key, text in texts_of(docs):
        for line in (text or "").split("\n"):
            lines[re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r")).encode()].add(key)
    repeats = {k for k, v in lines.items() if len(v) > 1 and len(k.decode()) >= 10}
    assert repeats <= suspects and len(suspects - repeats) < 0.01 * len(lines)


def test_lines_table(spark, odd_documents):
    out = line_dedup.without_repeated_lines(odd_documents.withColumnRenamed("key", "found").withColumnRenamed("spans", "n_lines"))
    rows = {r["doc_id"]: r for r in out.collect()}
    assert len(rows) == 9 and rows[1]["text"] is None and rows[7]["text"] == "" and rows[6]["text"] and rows[5]["text"] == "one"
    assert out.columns == [{"key": "found", "spans": "n_lines"}.get(c, c) for c in odd_documents.columns]
    assert line_dedup.dedup_lines(odd_documents.limit(0)).count() == 0
