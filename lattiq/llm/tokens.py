"""Encoding of whole texts by forced boundaries (operator 9)."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from . import base
from .bpe import encoder
from .words import slices


def encode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, ids binary`` (little-endian unsigned 32-bit integers) of each row of ``docs``.

    One row out per row in: a null text counts as empty and has no ids, repeated and null keys
    stay as they are, other columns are not read.  No shuffle.
    """

    def make():
        enc = encoder(path)

        def rows(columns):
            raw = base.raw_texts(columns[1])
            for i, j in slices([len(x) for x in raw]):
                ids, n = enc.encode_many(raw[i:j])
                parts = np.split(ids.astype("<u4"), np.cumsum(n)[:-1])
                yield [columns[0].slice(i, j - i), [x.tobytes() for x in parts]]

        return rows

    return base.mapped(docs.select(key, text), make, f"{key} long, ids binary")


def decode(ids: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """``key, text`` from the output of :func:`encode`; special tokens are kept."""

    def make():
        enc = encoder(path)

        def rows(columns):
            texts = [enc.decode(np.frombuffer(x or b"", "<u4")) for x in columns[1].to_pylist()]
            yield [columns[0], texts]

        return rows

    return base.mapped(ids.select(key, "ids"), make, f"{key} long, text string")


def round_trip(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode and decode each text in one pass; digests of ids and of the decoded text.

    ``key, n_tokens long, ids_sha256 string, decoded_sha256 string``.  Rows as in :func:`encode`.
    """

    def make():
        enc = encoder(path)

        def rows(columns):
            raw = base.raw_texts(columns[1])
            for i, j in slices([len(x) for x in raw]):
                ids, n = enc.encode_many(raw[i:j])
                parts = np.split(ids.astype("<u4"), np.cumsum(n)[:-1])
                yield [
                    columns[0].slice(i, j - i),
                    n,
                    [hashlib.sha256(x).hexdigest() for x in parts],
                    [hashlib.sha256(enc.decode(x).encode()).hexdigest() for x in parts],
                ]

        return rows

    ddl = f"{key} long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return base.mapped(docs.select(key, text), make, ddl)
