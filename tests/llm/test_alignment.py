import hashlib
import json
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from varloom.llm import alignment
from varloom.llm.registry import QUERIES

ODD = [
    (1, None),
    (2, ""),
    (3, "the cat sat on the mat"),
    (3, "the cat sat on the mat"),
    (None, "The cat\nsat  on\tthe mat. "),
    (5, "\nline one\nline two\n\n  indented 's \r\n x"),
    (6, " leading"),
    (7, "   "),
    (8, "\n"),
    (9, "<|endoftext|> <s> </s> <unk> <0x0A> it's 12345 a1b2"),
    (10, "naïve café 東京都 😀  nbsp wide \x1c sep \x00 nul"),
    (11, "a▁b ▁ c"),  # B's pieces write its spaces so: bytes differ
    (12, "x" * 3000),
    (13, "word " * 5000 + "\n" * 3),
    (14, "é́ ﻿bom ﬁ Ⅷ"),
    (15, "Zürich  line para \x85 next"),
]


def brute(rows):
    a = Tokenizer.from_file(alignment.A_FILE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.B_FILE)
    vocab = json.load(open(alignment.A_FILE, encoding="utf-8"))["model"]["vocab"]
    shown = [x for x in range(256) if 33 <= x < 127 or 161 <= x < 173 or x >= 174]
    byte = {chr(x): x for x in shown}
    for i, x in enumerate(x for x in range(256) if x not in shown):
        byte[chr(256 + i)] = x
    a_bytes = {i: bytes(byte[c] for c in t) for t, i in vocab.items()}
    b_bytes = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    docs = []
    for i, text in rows:
        whole = (" " + (text or "")).encode()
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        ax, by = [a_bytes[t] for t in x], [b_bytes(t) for t in y]
        if not text or b"".join(ax) != whole or b"".join(by) != whole:
            docs.append((i, [], [], [], ""))
            continue
        spans = lambda parts: [(sum(map(len, parts[:k])), sum(map(len, parts[: k + 1]))) for k in range(len(parts))] if len(parts) < 400 else running(parts)
        sx, sy = spans(ax), spans(by)
        links, j = [], 0
        for k, (s, e) in enumerate(sx):
            while sy[j][1] <= s:
                j += 1
            m = j
            while m < len(sy) and sy[m][0] < e:
                links.append((x[k], y[m]))
                m += 1
        both = sorted({e for _, e in sx} & {e for _, e in sy})
        groups, s = [], 0
        for e in both:
            groups.append(",".join(str(t) for t, p in zip(x, sx) if s < p[1] <= e) + "|" + ",".join(str(t) for t, p in zip(y, sy) if s < p[1] <= e) if len(x) < 400 else None)
            s = e
        if groups and groups[0] is None:
            groups = grouped(x, sx, y, sy, both)
        docs.append((i, x, y, links, ";".join(groups)))
    counts = Counter(p for d in docs for p in d[3])
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for i, x, y, links, told in docs:
        n_groups = told.count(";") + 1 if told else 0
        out.append((i, len(x), len(y), n_groups, len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(told.encode()).hexdigest() if told else ""))
    return out


def running(parts):
    out, at = [], 0
    for p in parts:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def grouped(x, sx, y, sy, both):
    out, i, j = [], 0, 0
    for e in both:
        k, m = i, j
        while k < len(x) and sx[k][1] <= e:
            k += 1
        while m < len(y) and sy[m][1] <= e:
            m += 1
        out.append(",".join(map(str, x[i:k])) + "|" + ",".join(map(str, y[j:m])))
        i, j = k, m
    return out


def key(r):
    return tuple(str(v) for v in r)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, keys string")


@pytest.mark.parametrize("block_bytes", [alignment.BLOCK_BYTES, 200])
def test_alignment_equals_brute_force(spark, block_bytes):
    got = alignment.aligned(frame(spark, ODD).repartition(3), block_bytes=block_bytes).collect()
    assert sorted(map(key, got)) == sorted(map(key, brute(ODD)))


def test_alignment_of_documents_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op12_token_alignment"](spark, sf).collect()
    assert sorted(map(key, got)) == sorted(map(key, brute(rows)))


def test_alignment_of_an_empty_table(spark):
    assert alignment.aligned(frame(spark, [])).collect() == []
    assert alignment.aligned(frame(spark, [(1, None)])).first()[1:] == (0, 0, 0, 0, 0, 0, "")


def test_units_encode_as_whole_texts_do():
    v = alignment.vocabularies(alignment.A_FILE, alignment.B_FILE)
    for _, text in ODD:
        if text:
            units = [alignment._whole(u) for u in v.split(text)]
            assert "".join(units) == " " + text
            a, b = v.encode(units)
            assert sum(a, []) == v.a.encode(" " + text, add_special_tokens=False).ids
            assert sum(b, []) == v.b.encode(text)


def test_units_that_workers_forget(monkeypatch, spark):
    monkeypatch.setattr(alignment, "KEPT_UNITS", 3)
    v, known = alignment.vocabularies(alignment.A_FILE, alignment.B_FILE), alignment.Known()
    first = alignment._block(v, known, [1, 2], ["the cat sat on the mat", "a dog"])
    again = alignment._block(v, known, [1, 2], ["the cat sat on the mat", "a dog"])
    assert first == again


def test_units_encoded_together_are_as_each_alone(monkeypatch):
    v = alignment.vocabularies(alignment.A_FILE, alignment.B_FILE)
    units = [alignment._whole(u) for _, t in ODD if t for u in v.split(t)]
    together = alignment.align(v, units)
    monkeypatch.setattr(alignment, "TOGETHER", -1)
    assert together == alignment.align(v, units) and None in together
