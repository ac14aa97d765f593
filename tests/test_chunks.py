"""Text windows against a plain Python form, and their properties."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallywork.functions import chunks as C

WINDOW, OVERLAP = 800, 200


def plain_segments(text):
    parts = []
    for para in re.split(r"\n\n+", text):
        if len(para) <= WINDOW:
            parts.append(para + "\n\n")
            continue
        for bullet in re.split(r"(?=\n[-•*] )", para):
            if len(bullet) <= WINDOW:
                parts.append(bullet)
            else:
                parts.extend(s + " " for s in re.split(r"(?<=[.!?])\s+", bullet))
    return [p for p in parts if p.strip()]


def plain_windows(text):
    room = WINDOW - OVERLAP
    pieces = [s[i : i + room] for s in plain_segments(text) for i in range(0, len(s), room)]
    done, current = [], ""
    for piece in pieces:
        if len(current) + len(piece) > WINDOW:
            done.append(current.strip())
            current = current[-OVERLAP:]
        current += piece
    return done + ([current.strip()] if current.strip() else [])


def windows(spark, texts, **options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    return [r.w for r in df.select("i", C.windows(F.col("t"), **options).alias("w")).orderBy("i").collect()]


words = st.text("abcdefgh", min_size=1, max_size=12)
ends = st.sampled_from([" ", ". ", "! ", "\n\n", "\n- ", "\n"])
prose = st.lists(st.tuples(words, ends), min_size=1, max_size=60).map(lambda ps: "".join(w + e for w, e in ps) * 8)


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(prose, min_size=1, max_size=5))
def test_like_plain_python(spark, texts):
    expected = [plain_windows(t) for t in texts]
    assert windows(spark, texts) == expected
    assert windows(spark, texts, max_windows=4) == [w[:4] for w in expected]
    assert all(len(w) <= WINDOW for ws in expected for w in ws)


def test_no_text_is_lost_after_an_over_long_segment(spark):
    """Segments beyond the room left by the overlap used to repeat the overlap until the cap."""
    text = "x" * 700 + ". " + "y" * 700 + ". " + "z" * 2500
    (found,) = windows(spark, [text], max_windows=None)
    assert all(len(w) <= WINDOW for w in found)
    assert sum(w.count("y") for w in found) >= 700 and sum(w.count("z") for w in found) >= 2500


def test_short_blank_and_missing(spark):
    assert windows(spark, ["one line", "  \n\n ", ""]) == [["one line"], [], []]
    assert windows(spark, [None]) == [None]


def test_unstructured_posting(spark):
    row = dict(title="Dev", company="Co", location=None, job_type="contract", is_remote=True, summary=None, salary=None,
               min_salary=50000, max_salary=None, description="Short text.")
    df = spark.createDataFrame([row], ", ".join(f"{k} {'INT' if 'salary' in k and '_' in k else 'BOOLEAN' if k == 'is_remote' else 'STRING'}" for k in row))
    for name in ("responsibilities", "requirements", "benefits", "skills"):
        df = df.withColumn(name, F.array().cast("array<string>"))
    (found,) = [r.c for r in df.select(C.build_chunks({c: F.col(c) for c in df.columns}).alias("c")).collect()]
    assert [tuple(c) for c in found] == [
        ("identity", "Dev at Co. contract."),
        ("salary", "Dev at Co. Salary: $50,000 per year."),
        ("requirements", "Short text."),
    ]
