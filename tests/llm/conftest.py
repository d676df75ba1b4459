from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

LONG = " ".join(f"Wort{k % 977}x{k}" for k in range(30_000))
PASSAGE = "the very same passage of words stands in many documents and is longer than fifty bytes by far "
TEXTS = [
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "one"),
    (5, "ONE"),
    (6, "eins zwei drei vier"),
    (7, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda my ny xi omikron"),
    (8, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda my ny xi omikron"),
    (9, "Alpha beta  gamma delta epsilon zeta eta theta iota kappa lambda my ny xi omikron"),
    (10, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda my ny xi omikron pi"),
    (10, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda my ny xi omikron pi"),
    (11, PASSAGE + "and then something else follows, été 漢字 \U0001f600"),
    (12, "first comes a preface. " + PASSAGE + "ends"),
    (13, PASSAGE * 3),
    (14, LONG),
    (15, LONG + " tail"),
    (16, "x" * 5_000),
    (17, "ééééééééééééééééééééééééééééééééééééééééééééééééééé" * 2),
    (18, "aéééééééééééééééééééééééééééééééééééééééééééééééééééa"),
    (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda my ny xi omikron"),
    (None, None),
    (2**53 + 1, "ids beyond the whole numbers that doubles tell apart"),
    (2**53 + 3, "ids beyond the whole numbers that doubles  tell apart"),
    (2**53 + 5, "another text of such an id"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns named like the operators' own."""
    rows = [(i, t, 7, "s", b"b", -1, True, 1.5, "q") for i, t in TEXTS]
    return spark.createDataFrame(
        rows, "doc_id long, text string, row int, source string, node binary, run int, kept boolean, score double, label string"
    ).repartition(3)


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
