"""The CSV tokeniser in column functions against one character by character."""

import random
import time
from collections import Counter

from pyspark.sql import functions as F

from ledgerloom.plans import statement_queries
from ledgerloom.sources import statements

from .conftest import rows


def by_character(text, mark):
    """(line, fields) of each row that is not blank."""
    out, row, field, quoted, line, start, i = [], [], "", False, 1, 1, 0
    while i <= len(text):
        c = text[i] if i < len(text) else None
        if quoted and c is not None:
            if c == '"' and text[i + 1 : i + 2] == '"':
                field, i = field + '"', i + 1
            elif c == '"':
                quoted = False
            else:
                field, line = field + c, line + (c == "\n")
        elif c == '"' and field == "":
            quoted = True
        elif c == mark:
            row, field = [*row, field.strip() or None], ""
        elif c in ("\r", "\n", None):
            i += c == "\r" and text[i + 1 : i + 2] == "\n"
            row, field = [*row, field.strip() or None], ""
            if any(row):
                out.append((start, row))
            row, line = [], line + 1
            start = line
        else:
            field += c
        i += 1
    return out


def usual_delimiter(text):
    lines = [x for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n") if x.strip()][:10]
    best, most = ",", -1.0
    for d in ",;\t|":
        counts = Counter(sum(p.count(d) for p in x.split('"')[::2]) for x in lines)
        if lines and set(counts) != {0}:
            n, times = counts.most_common(1)[0]
            if times / len(lines) * n > most:
                best, most = d, times / len(lines) * n
    return best


PLAIN = ["a", "12.5", "", " x ", " y", "tail ", '"q"', '"a,b"', '"say ""hi"""', '""', '"two\nlines"', '"cr\r\nlf"', '" "', '"\n"', '""""']
ODD = ['5" pipe', '"x"y', 'a"b"', '"open', ' "late"', '"a" ']


def test_rows_against_a_loop_over_characters(spark):
    rng, texts = random.Random(6), []
    for k in range(400):
        parts = PLAIN if k % 3 else PLAIN + ODD
        mark, end = rng.choice(",;\t|"), rng.choice(["\n", "\r\n", "\r"])
        text = end.join(mark.join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 6)))
        texts.append(("﻿" if k % 7 == 0 else "") + text + rng.choice(["", end, end * 2]))
    texts += ["", "﻿", " \n\t\r\n", "no delimiter", ",private\n,use", "a,b c\n", "x\x85,y\x1c\n"]
    files = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)] + [("null", None)], "file string, content string").repartition(4)
    got = rows(statements.csv_rows(files), "file", "source_pos", "line_no", "fields", "delimiter")
    want = []
    for i, t in enumerate(texts):
        t = t.removeprefix("﻿")
        mark = usual_delimiter(t)
        want += [(str(i), n, line, fields, mark) for n, (line, fields) in enumerate(by_character(t, mark))]
    assert got == sorted(want, key=repr)
    stated = rows(statements.csv_rows(files, delimiter=";"), "file", "fields")
    assert stated == sorted(((str(i), f) for i, t in enumerate(texts) for _, f in by_character(t.removeprefix("﻿"), ";")), key=repr)


def test_files_without_odd_quotes_stay_in_the_jvm(spark):
    """Only the branch for odd quotes has Python in it, and it gets no rows of other files."""
    files = spark.createDataFrame([("a", 'x,"y, z"\n1,"2\n3"\n'), ("b", 'x,5" y\n')], "file string, content string")
    plan = statements.csv_rows(files)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1
    assert rows(statements.csv_rows(files), "file", "line_no", "fields") == [("a", 1, ["x", "y, z"]), ("a", 2, ["1", "2\n3"]), ("b", 1, ["x", '5" y'])]


def test_files_and_rows_are_read_once(spark):
    """Delimiters are not told again by what filters the rows, nor dates and amounts by what tells good rows from bad ones."""
    files = spark.createDataFrame([("a", "Date,Payee,Amount\n2024-01-31,shop,1.50\nsomeday,shop,1.50\n")], "file string, content string")
    assert "content" not in statements.csv_rows(files)._jdf.queryExecution().optimizedPlan().toString()
    parsed, problems = statements.csv_transactions(files)
    assert "regexp_replace" not in parsed._jdf.queryExecution().optimizedPlan().toString()
    assert rows(parsed, "file", "source_pos", "amount_minor") == [("a", 1, 150)]
    assert rows(problems, "file", "location", "message") == [("a", "line 3", "Could not read 'someday' as a date")]


def test_many_quotes_in_one_file(spark):
    """The pieces between quotes are split once: 2 x 20,000 pieces that each split the file's text again took minutes."""
    text = "\n".join(f'{i},"a, b","c"' for i in range(10_000))
    began = time.monotonic()
    found = statements.csv_rows(spark.createDataFrame([("many.csv", text)], "file string, content string"))
    got = found.agg(F.count(F.lit(1)), F.sum(F.size("fields")), F.max("fields"), F.max("line_no")).first()
    assert tuple(got) == (10_000, 30_000, ["9999", "a, b", "c"], 10_000)
    assert time.monotonic() - began < 60


def test_mapping_by_words_needs_no_profile_but_rows(spark):
    """Words of the header settle a file that has rows; a header without a description, and none at all, still take the columns' profile."""
    texts = {
        "words": "Date,Payee,Amount\n13/02/2024,Shop,1.50\n14/02/2024,,2.00",
        "head only": "Date,Payee,Amount",
        "no description": "Date,Amount,What\n02/13/2024,1.50,Shop",
        "no header": "2024-02-13,Shop of words,1.50",
    }
    rows = statements.csv_rows(spark.createDataFrame(list(texts.items()), "file string, content string"))
    found = statements.detect_mapping(rows, statements.headers(rows))
    got = {r["file"]: (r["confidence"], r["mapping"]["description_columns"], r["mapping"]["day_first"]) for r in found.collect()}
    assert got == {"words": ("HEADER_MATCH", [1], True), "no description": ("HEADER_MATCH", [2], False), "no header": ("CONTENT_GUESS", [1], False)}


def test_profile_of_files_without_header(spark, monkeypatch):
    """The same as of all rows, wherever the first row stands; files with a header are not split into rows, nor their fields kept."""
    texts = ["2024-01-31,Shop,1.50\n2024-02-01,,2", "\n\r\n2024-01-31;a b;1\r\n", '2024-01-31,"two\nlines",1\n2024-02-01,x,2', '2024-01-31,5" pipe,1\nx,y"z,n/a', '"Da\nte",What,Sum\n2024-01-31,x,1', "Date,Payee,Amount\n2024-01-31,x,1", " , \n,,\n1.5,x", "Da\"te,x\n1,2", "\n\n", ""]
    files = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)] + [("null", None)], "file string, content string")
    all_rows = statements.csv_rows(files)
    want = rows(statements.profile_columns(all_rows, statements.headers(all_rows).filter("not is_header")))
    assert {r[0] for r in want} == {"0", "1", "2", "3", "6"}
    assert rows(statements.profile_headerless(files)) == want

    kept, settle = [], statements.settled
    for module in (statements, statement_queries):
        monkeypatch.setattr(module, "settled", lambda df: kept.append(settle(df)) or kept[-1])
    for query in (statement_queries.column_profile, statement_queries.column_amounts):
        kept.clear()
        assert query(spark, "/root/testdata/sf0.001").count() > 0
        assert kept and not any("fields" in df.columns for df in kept)
        assert [df.filter("int(substring_index(substring(file, 2), '.', 1)) % 6 <> 2").count() for df in kept[1:]] == [0]
