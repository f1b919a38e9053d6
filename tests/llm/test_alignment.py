import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from courtflow.llm import alignment
from courtflow.llm.alignment import align, aligned_groups, link_scores, packed_pairs, unpacked_pairs, vocabulary
from helpers import clashing, documents, empty, odd

A, B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
TEXTS = [
    None, "", " ", "the reed house", "▁ mark", "a▁b", "straße 12 ß é 漢字かな 한국 \U0001f600\U0001f469‍\U0001f680", "<|endoftext|> <s></s> <unk> <0x41>", "\n\n\t  x  \r\n", "tab\tend ", "  x​\x00y",
    "'s 't I'll don't WE'RE", "é", "<0x0A>\n", "    leading", "a" * 70_000, " " * 30_000, "the reed house", "x�y﻿", "١٢٣ ⅷ ²", "á é́", "\x85  ᠎\x1c",
]


def by_library(path, texts):
    """Ids and bytes of each id from the libraries themselves, one text at a time."""
    if path == A:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        units = _units()
        return [t.encode(" " + x, add_special_tokens=False).ids for x in texts], lambda i: bytes(units[c] for c in t.id_to_token(i))
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [m.encode(x) for x in texts], lambda i: bytes([int(m.id_to_piece(i)[3:-1], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode()


def _units():
    if not hasattr(_units, "table"):
        printable = list(range(ord("!"), ord("~") + 1)) + list(range(ord("¡"), ord("¬") + 1)) + list(range(ord("®"), ord("ÿ") + 1))
        table, n = {chr(b): b for b in printable}, 0
        for b in range(256):
            if b not in printable:
                table[chr(256 + n)] = b
                n += 1
        _units.table = table
    return _units.table


def plain(rows):
    """The contract, by loops."""
    texts = [t or "" for _, t in rows]
    (ids_a, bytes_a), (ids_b, bytes_b) = by_library(A, texts), by_library(B, texts)
    per, total = [], Counter()
    for text, a, b in zip(texts, ids_a, ids_b, strict=True):
        whole = (" " + text).encode()
        ta, tb = [bytes_a(i) for i in a], [bytes_b(i) for i in b]
        if not text or b"".join(ta) != whole or b"".join(tb) != whole:
            per.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in ta]).tolist(), np.cumsum([len(x) for x in tb]).tolist()
        place = {e: j for j, e in enumerate(ends_b)}
        links = [(a[i], b[place[e]]) for i, e in enumerate(ends_a) if e in place]
        cuts = [e for e in ends_a if e in place]
        groups, low = [], 0
        for cut in cuts:
            groups.append((",".join(str(x) for x, e in zip(a, ends_a, strict=True) if low < e <= cut), ",".join(str(x) for x, e in zip(b, ends_b, strict=True) if low < e <= cut)))
            low = cut
        total.update(links)
        per.append((len(a), len(b), links, ";".join("|".join(g) for g in groups)))
    most = {}
    for (_, b), n in total.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for (doc, _), p in zip(rows, per, strict=True):
        if p is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, links, text = p
            out.append((doc, n_a, n_b, len(links), len(links), sum(total[k] == most[k[1]] for k in links), sum(total[k] for k in links), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("sent", [4_000_000, 0])
def test_like_plain(spark, sent, monkeypatch):
    rnd = random.Random(8)
    small = [t for t in TEXTS if t is None or len(t) < 100]
    words = ["the", "reed", "hé", "12", ".", "\n", "  ", "漢", "-ing", "Ünder", "ﬁ", "'s"]
    rows = list(enumerate(small + ["".join(rnd.choice(words) + rnd.choice(["", " "]) for _ in range(rnd.randrange(40))) for _ in range(120)]))
    rows += [(3, "the reed house"), (None, "no id"), (None, None)]
    monkeypatch.setattr(alignment, "HELD_PAIRS", 50)
    got = link_scores(align(documents(spark, rows).repartition(3), A, B), sent).select(*COLUMNS)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)


def test_same_ids_as_the_libraries():
    rnd = random.Random(2)
    texts = [t for t in TEXTS if t]
    alphabet = "abcdefghij  \n'stéß漢😀\t .,-_<|>ABC019²١́‍"
    texts += ["".join(rnd.choice(alphabet) for _ in range(60)) for _ in range(2000)]
    v = vocabulary(A)
    assert v.fast is not None
    want, _ = by_library(A, texts)
    assert [list(x) for x in v.encode(texts)] == want
    assert vocabulary(B).encode(texts) == by_library(B, texts)[0]


def test_groups_hold_the_same_bytes(spark):
    df = documents(spark, list(enumerate(TEXTS)))
    va, vb = vocabulary(A), vocabulary(B)
    for r in aligned_groups(clashing(df).drop("groups"), A, B).collect():
        at, whole = 0, (" " + (r.text or "")).encode()
        for g in r.groups:
            piece = whole[g.start : g.end]
            assert g.start == at and va.spelled(np.array(g.a)).tobytes() == piece == vb.spelled(np.array(g.b)).tobytes()
            at = g.end
        assert at == (len(whole) if r.groups else 0)
        assert bool(r.groups) == bool(r.text and "▁" not in r.text)


def test_odd_tables(spark):
    df = odd(spark)
    got = link_scores(align(clashing(df), A, B))
    assert got.count() == df.count()
    assert {(r.n_a, r.groups_sha256) for r in got.where("doc_id = 2 OR doc_id = 3").collect()} == {(0, "")}
    assert len({(r.n_a, r.count_sum, r.groups_sha256) for r in got.where("doc_id = 5").collect()}) == 1
    for sent in (0, 10):
        assert link_scores(align(empty(spark), A, B), sent).count() == 0


def test_packing():
    k, n = np.array([1, 5 << 40, 7 << 41], np.int64), np.array([3, 1, 1 << 33], np.int64)
    assert [x.tolist() for x in unpacked_pairs(packed_pairs(k, n))] == [k.tolist(), n.tolist()] and packed_pairs(k[:0], n[:0]) == b""
