import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from vesperline.llm import alignment

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, batch string, codes string, pair string"


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B), alignment._byte_alphabet()


def plain(text, libraries):
    """(A ids, B ids, groups, links) from the whole text at once; None without tokens."""
    a, b, alphabet = libraries
    if not text:
        return None
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    bytes_a = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    raw = (" " + text).encode()
    if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
        return None
    ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
    common = sorted(set(ends_a) & set(ends_b))
    groups, start = [], 0
    for end in common:
        groups.append(([i for i, e in zip(ids_a, ends_a) if start < e <= end], [i for i, e in zip(ids_b, ends_b) if start < e <= end]))
        start = end
    links = []
    for i, (s, e) in enumerate(zip([0, *ends_a], ends_a)):
        for j, (t, f) in enumerate(zip([0, *ends_b], ends_b)):
            if s < f and t < e:
                links.append((ids_a[i], ids_b[j]))
    return ids_a, ids_b, groups, links


def brute(rows, libraries):
    found = [(doc_id, plain(text, libraries)) for doc_id, text in rows]
    count = Counter(p for _, x in found if x for p in set(x[3]))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for doc_id, x in found:
        if not x:
            out.append((doc_id, 0, 0, 0, 0, 0, "", 0, 0))
            continue
        ids_a, ids_b, groups, links = x
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        within = sum(len(ga) * len(gb) for ga, gb in groups)
        out.append((doc_id, len(ids_a), len(ids_b), len(groups), len(links), within, hashlib.sha256(text.encode()).hexdigest(), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links)))
    return sorted(out, key=str)


TEXTS = [
    None, "", " ", "\n", "a", "Hello, world!  two  spaces ", "\n\nlines\nof text\n \n end\n", " leading", "tab\tand wide　space", "<|endoftext|> <s> </s> <0x41> <unk>",
    "▁mark", "x▁ y ▁ z", "日本語 テスト\nрусский текст", "😀 é é ﬁ ² Ⅷ", "it's they'll 1234 5,6", "\x00\x1f\x7f\x85", "z" * 500, "word " * 400, "a \n b", "don't\nstop\x1cnow here",
]


def test_whole_operator_equals_brute_force(spark, libraries):
    rng = random.Random(3)
    alphabet = "aabbcde  \n.,'\t é日😀▁1<>|\r"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(300)] + ["one two three " * rng.randrange(9) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "one two"), (3, "one two"), (3, "one two")]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)
    want = brute(rows, libraries)
    for size in (1 << 24, 300):
        out = alignment.align_documents(df, A, B, batch_chars=size)
        assert sorted(map(tuple, out.collect()), key=str) == want
    assert alignment.align_documents(df.where("false"), A, B).count() == 0


def test_parts_kept_from_before_change_nothing(libraries):
    whole = alignment.Aligner(alignment.Tokens(A, B))
    first = whole.documents(TEXTS)
    again = [whole.documents([t])[0] for t in TEXTS]
    for x, y in zip(first, again):
        assert x[:2] == y[:2] and (x[2] == y[2]).all() and (x[3] == y[3]).all()


def dense(m):
    out = np.zeros((m.rows, m.columns), int)
    out[m.row_of_each(), m.indices] = 1
    return out


def test_products_equal_dense_ones():
    rng = np.random.default_rng(4)
    for _ in range(30):
        n, k, m = rng.integers(1, 9, 3)
        a, b = (rng.random(s) < 0.3 for s in ((n, k), (k, m)))
        sparse = lambda x: alignment.Matrix(np.concatenate(([0], np.cumsum(x.sum(1)))), np.nonzero(x)[1], x.shape[1])
        got = alignment.product(sparse(a), sparse(b))
        assert (dense(got) == ((a.astype(int) @ b.astype(int)) > 0)).all() and got.indptr[-1] == len(got.indices)
        assert (dense(sparse(a).transposed()) == a.T).all()


def test_links_within_groups(spark, libraries):
    texts = [t for t in TEXTS if t] + ["one two three " * 50]
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in enumerate(texts)], SCHEMA)
    got = defaultdict(set)
    for r in alignment.group_links(df, A, B).collect():
        got[r.doc_id].add((r.a, r.b))
    for i, t in enumerate(texts):
        want, at_a, at_b = set(), 0, 0
        for ga, gb in (plain(t, libraries) or (0, 0, []))[2]:
            want |= {(at_a + x, at_b + y) for x in range(len(ga)) for y in range(len(gb))}
            at_a, at_b = at_a + len(ga), at_b + len(gb)
        assert got[i] == want
    one = alignment.Matrix.intervals(np.array([2, 3, 1]))
    assert len(list(alignment.shared_groups(one, one, 4))) > 1
