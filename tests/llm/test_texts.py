"""BPE and licences: round trips, brute force and odd rows."""

import hashlib
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from murmura.llm import byte_bpe, licenses
from tests.conftest import DATA

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id bigint, text string, ids string"


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def codec(ranks):
    return byte_bpe.Codec(byte_bpe.serialize_model(ranks), ranks, P.PATTERN)


@pytest.fixture(scope="module")
def reference(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(deadline=None, max_examples=300)
@given(st.text(max_size=60))
def test_same_ids_as_tiktoken(codec, reference, text):
    text = text.encode("utf-8", "ignore").decode()
    ids, decimal = codec.encode(text)
    assert list(ids) == reference.encode_ordinary(text)
    assert decimal == ",".join(map(str, ids)) and codec.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["", " ", "a" * 3000, "  x\n\n y", "don't I'll", "<unk> ▁a", "\x00\x1c\x85", "日本語🎉", "\U000e7b2a\U00033000a", "no space " * 2000])
def test_hard_texts(codec, reference, text):
    assert list(codec.encode(text)[0]) == reference.encode_ordinary(text)


def test_alphabet_is_one_to_one():
    letters = byte_bpe.byte_alphabet()
    assert len(set(letters)) == 256 and " " not in letters


def test_ranks_must_be_whole():
    with pytest.raises(ValueError):
        byte_bpe.serialize_model({b"a": 0, b"b": 2})


def test_digests_against_tiktoken(spark, ranks, reference):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = byte_bpe.digests(docs, ranks, P.PATTERN).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = reference.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_encode_then_decode(spark, ranks):
    rows = [(1, "héllo wörld", "x"), (2, None, None), (3, "", "x"), (3, "", "x"), (None, "z" * 20_000, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    back = byte_bpe.decode(byte_bpe.encode(df, ranks, P.PATTERN), ranks, P.PATTERN)
    assert sorted((str(r.doc_id), bytes(r.decoded).decode()) for r in back.collect()) == sorted((str(i), t or "") for i, t, _ in rows)
    assert byte_bpe.digests(spark.createDataFrame([], SCHEMA), ranks, P.PATTERN).count() == 0


def scan(spark, *texts):
    df = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)], "doc_id int, text string, license_id string")
    return [(r.license_id, r.line_licenses, r.n_license_lines) for r in licenses.scan(df).orderBy("doc_id").collect()]


def test_whole_licences_in_other_spellings(spark):
    mit = licenses.MIT
    shouted = "MIT LICENCE\n\nCopyright (c) 2020 Someone\nCopyright 2021 Another\n\n" + mit.upper().replace("NONINFRINGEMENT", "NON-INFRINGEMENT").replace("\n", "\n   ")
    quoted = mit.replace('"', "“", 1).replace('"', "”", 1).replace(",", " ,")
    got = scan(spark, mit, shouted, quoted, mit + " and more", licenses.BSD_HEAD + licenses.BSD_TAIL, licenses.APACHE_NOTICE.replace("http:", "https:"))
    assert [g[0] for g in got] == ["MIT", "MIT", "MIT", None, "BSD-2-Clause", "Apache-2.0"]


def test_lines_and_odd_rows(spark):
    got = scan(
        spark, "text\nLicensed under the Apache Licence, version 2.0\nmore\n// SPDX-License-Identifier: MIT", "Released under the MIT License.\nreleased under the mit licence", None, "", "Copyright 2020 only", "no licence here", "x" * 100_000
    )
    assert got == [(None, ["Apache-2.0", "MIT"], 2), (None, ["MIT"], 2)] + [(None, [], 0)] * 5
    assert licenses.scan(spark.createDataFrame([], "doc_id int, text string")).count() == 0


def test_own_texts(spark):
    df = spark.createDataFrame([(1, "My OWN terms!"), (2, "my own terms"), (3, "other")], "doc_id int, text string")
    got = licenses.scan(df, [("own", "My own terms")]).orderBy("doc_id").collect()
    assert [r.license_id for r in got] == ["own", "own", None]


def test_known_digests_name_one_licence(spark):
    found = licenses.known_digests(spark)
    assert len({d for d, _ in found}) == len(found) and {"MIT", "Apache-2.0", "GPL-3.0-only"} <= {x for _, x in found}


def test_every_notice_is_found_as_a_line(spark):
    notices = [(i, t) for i, t in licenses.known_texts() if "\n" not in t]
    got = scan(spark, *[f"first\n{t}\nlast" for _, t in notices])
    assert [g[1:] for g in got] == [([i], 1) for i, _ in notices]
    df = spark.createDataFrame([(1, "first\nmy OWN terms!\nlast")], "doc_id int, text string")
    assert licenses.scan(df, [("own", "My own terms")]).first().line_licenses == ["own"]


def test_whole_official_texts(spark):
    shelf = Path("/usr/share/common-licenses")
    names = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only", "MPL-2.0": "MPL-2.0", "GFDL-1.3": "GFDL-1.3-only"}
    there = [(spdx, (shelf / f).read_text("utf-8")) for f, spdx in names.items() if (shelf / f).exists()]
    if not there:
        pytest.skip("no licence texts on this machine")
    assert [g[0] for g in scan(spark, *[t.replace("\n", "\n ") for _, t in there])] == [spdx for spdx, _ in there]


def test_too_many_known_texts(spark):
    with pytest.raises(ValueError):
        licenses.known_digests(spark, [("x", str(i)) for i in range(licenses.MOST_KNOWN + 1)])
