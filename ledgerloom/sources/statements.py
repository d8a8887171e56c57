"""Statement files (CSV, OFX/QFX, QIF) to transactions and problems, many files in parallel.

A file is a row; files are a few MB at most. OFX and QIF are read by built-in functions alone, and so are CSV files whose quotes stand
where fields begin and end: what stands between them is told by counting quotes. CSV files with other quotes need a tokeniser with state,
and only their rows come from mapInPandas.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.amounts import let, parse_amount_minor, parse_decimal, trimmed
from ..functions.dates import infer_date_order, parse_date
from ..functions.money import with_scale
from ..functions.reference import HEADER_WORDS, MAPPING, bank_profiles
from .shared import settled

SNIFFED = 512
#: Rows looked at when columns are told by their content, lines when the delimiter is.
SAMPLED_ROWS = 50
SAMPLED_LINES = 10
# Delimiters in the order in which ties are broken, and how summary rows begin.
DELIMITERS = ",;\t|"
SUMMARY = r"(?i)^(?:total|totals|beginning balance|ending balance|opening balance|closing balance|balance forward|subtotal)\b"


class Statements(NamedTuple):
    parsed: DataFrame
    problems: DataFrame
    files: DataFrame


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """file, content, format: a row per file below the path. Spark's file sources have no row for a file of no bytes."""
    return with_format(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content")))


def with_format(files: DataFrame) -> DataFrame:
    """The format by the content's first characters, whatever the name says; the name only tells QFX from OFX."""
    head = F.substring("content", 1, SNIFFED)
    ofx = head.rlike("(?i)<OFX>|OFXHEADER")
    kind = F.when(ofx, F.when(F.lower("file").endswith(".qfx"), "QFX").otherwise("OFX")).when(head.rlike(r"(?i)^\s*!TYPE:"), "QIF").otherwise("CSV")
    return files.withColumn("format", kind)


def problem(location: Column, message: Column | str, severity: str, raw: Column | None = None) -> Column:
    message = F.lit(message) if isinstance(message, str) else message
    return F.struct(location.alias("location"), message.alias("message"), F.lit(severity).alias("severity"), (F.lit(None) if raw is None else raw).cast("string").alias("raw_content"))


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a struct `problem` or none, apart."""
    good = rows.filter("problem is null").select(
        "file",
        "format",
        "source_pos",
        "posted_date",
        "amount_minor",
        "currency",
        "raw_description",
        F.col("institution_transaction_id").cast("string").alias("institution_transaction_id"),
        F.lit(False).alias("is_pending"),
        "source_location",
        F.lit(1.0).alias("confidence"),
    )
    return good, rows.filter("problem is not null").select("file", "problem.*")


def _file_problem(files: DataFrame, message: str) -> DataFrame:
    return files.select("file", problem(F.lit("file"), message, "ERROR").alias("p")).select("file", "p.*")


# -- CSV ---------------------------------------------------------------------------------------


_EDGES = r"^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$"
_NOT_BLANK = r"[^\s\p{Z}\x1c-\x1f\x85]"
_NO_EDGES = rf"(?s)\A{_NOT_BLANK}(?:.*{_NOT_BLANK})?\z"
#: Stand for a delimiter and line breaks inside quotes: characters that no text has a meaning for.
_KEPT_DELIMITER, _KEPT_RETURN, _KEPT_LINE = "\ue000", "\ue001", "\ue002"


def _bare(text: Column) -> Column:
    """Without white space of any kind at the edges."""
    return F.regexp_replace(text, _EDGES, "")


def _lines(text: Column) -> Column:
    """The lines of a text. One character splits faster than an expression."""
    return F.split(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), "\n")


def detected_delimiter(text: Column) -> Column:
    """Of the delimiters, the one whose usual number on the first lines, times the share of lines that have just so many, is greatest; the first
    of equal ones; a comma if no line has any. What stands at even places between quotes of a line is outside of them."""
    lines = F.slice(F.filter(_lines(text), lambda x: x.rlike(_NOT_BLANK)), 1, SAMPLED_LINES)
    outside = F.transform(lines, lambda x: F.when(x.contains('"'), F.array_join(F.filter(F.split(x, '"'), lambda _, i: i % 2 == 0), "")).otherwise(x))

    def score(outside: Column, place: int, mark: str) -> Column:
        def of(counts: Column) -> Column:
            most = F.array_max(F.transform(counts, lambda n, i: F.struct(F.size(F.filter(counts, lambda m: m == n)).alias("lines"), (-i).alias("i"), n.alias("n"))))
            uneven = let(most, lambda usual: usual["lines"] / F.size(counts) * usual["n"])
            even = F.array_min(counts) == F.array_max(counts)
            return F.when(F.array_max(counts) > 0, F.struct(F.when(even, counts[0].cast("double")).otherwise(uneven).alias("score"), F.lit(-place).alias("place"), F.lit(mark).alias("mark")))

        return let(F.transform(outside, lambda x: F.octet_length(x) - F.octet_length(F.replace(x, F.lit(mark), F.lit("")))), of)

    return F.coalesce(let(outside, lambda o: F.greatest(*[score(o, k, d) for k, d in enumerate(DELIMITERS)]))["mark"], F.lit(DELIMITERS[0]))


def _unquoted(text: Column, mark: Column) -> Column:
    """The text without its quotes, delimiters and line breaks inside them kept apart by other characters; null if a quote stands elsewhere
    than at the edge of a field. Of the pieces between quotes, an empty one outside is a doubled quote. The pieces and their number are
    bound: a lambda that named the split itself would split the whole text for every piece."""
    split = let(F.split(text, '"'), lambda pieces: let(F.size(pieces) - 1, lambda last: _joined(pieces, last, mark)))
    return F.when(text.contains('"'), split).otherwise(text)


def _joined(pieces: Column, last: Column, mark: Column) -> Column:
    edge = lambda c: (c == mark) | c.isin("\r", "\n")
    at_edges = lambda p, i: (i % 2 == 1) | (p == "") | (((i == 0) | edge(F.substring(p, 1, 1))) & ((i == last) | edge(F.right(p, F.lit(1)))))
    inside = lambda p: F.replace(F.replace(F.replace(p, mark, F.lit(_KEPT_DELIMITER)), F.lit("\r"), F.lit(_KEPT_RETURN)), F.lit("\n"), F.lit(_KEPT_LINE))
    joined = F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, inside(p)).when((p == "") & (i > 0) & (i < last), '"').otherwise(p)), "")
    return F.when((last % 2 == 0) & F.forall(F.transform(pieces, at_edges), lambda ok: ok), joined)


def _records(text: str, delimiter: str) -> Iterator[tuple[int, list[str]]]:
    """(line of the row's start, trimmed fields) of each row that is not blank. Quotes open only at the start of a field and double inside."""
    line = start = 1
    fields: list[str] = []
    field: list[str] = []
    quoted, i, n = False, 0, len(text)
    while i <= n:
        c = text[i] if i < n else "\n"
        if quoted and i < n:
            if c != '"':
                line += c == "\n"
                field.append(c)
            elif text[i + 1 : i + 2] == '"':
                field.append(c)
                i += 1
            else:
                quoted = False
        elif c == '"' and not field:
            quoted = True
        elif c == delimiter:
            fields.append("".join(field))
            field = []
        elif c in "\r\n":
            i += c == "\r" and text[i + 1 : i + 2] == "\n"
            fields.append("".join(field))
            if any(x.strip() for x in fields):
                yield start, [x.strip() for x in fields]
            fields, field, line = [], [], line + 1
            start = line
        else:
            field.append(c)
        i += 1


def _fields(line: Column, mark: Column) -> Column:
    """The trimmed fields of a line, blank ones null."""
    back = lambda x: F.replace(F.replace(F.replace(x, F.lit(_KEPT_DELIMITER), mark), F.lit(_KEPT_RETURN), F.lit("\r")), F.lit(_KEPT_LINE), F.lit("\n"))
    # A character behind a backslash splits without an expression, but letters and digits mean another thing there.
    alone = F.when(mark.rlike(r"\A[^A-Za-z0-9]\z"), F.concat(F.lit("\\"), mark)).otherwise(F.concat(F.lit("\\Q"), mark, F.lit("\\E")))
    return F.transform(F.split(line, alone), lambda x: let(back(x), lambda v: F.when(v.rlike(_NO_EDGES), v).when(v.rlike(_NOT_BLANK), _bare(v))))


def csv_rows(files: DataFrame, delimiter: str | None = None) -> DataFrame:
    """file, source_pos (from 0), line_no, fields (blank ones null), delimiter: the rows of CSV files, blank ones left out. Rows end with
    \\n, \\r or both; quotes open at the start of a field only and double inside. A blank, empty or null file has no rows.
    Who asks for the rows more than once settles them."""
    return rows_of_texts(csv_texts(files, delimiter))


def csv_texts(files: DataFrame, delimiter: str | None = None) -> DataFrame:
    """file, delimiter, plain, text, first: CSV files ready to be split: without quotes in `plain`, or as they are in `text` where their quotes
    need a tokeniser; in `first` the fields of the first line, null if it is blank or not told yet.

    Settled: a filter would else be moved below the delimiters and tell them anew for every piece and field."""
    text = F.regexp_replace("content", "^\ufeff", "")
    told = files.filter("content is not null").select("file", text.alias("text"))
    told = told.withColumn("delimiter", detected_delimiter(F.col("text")) if delimiter is None else F.lit(delimiter))
    kept = f"[{_KEPT_DELIMITER}{_KEPT_RETURN}{_KEPT_LINE}]"
    told = told.withColumn("plain", F.when(~F.col("text").rlike(kept), _unquoted(F.col("text"), F.col("delimiter"))))
    line = F.substring_index(F.substring_index(F.col("plain"), "\n", 1), "\r", 1)
    first = let(_fields(line, F.col("delimiter")), lambda fields: F.when(F.exists(fields, lambda x: x.isNotNull()), fields))
    return settled(told.select("file", "delimiter", "plain", F.when(F.col("plain").isNull(), F.col("text")).alias("text"), first.alias("first")))


def first_rows(texts: DataFrame) -> DataFrame:
    """file, fields: the first row of each text. Most have it on their first line; only the others are split for it."""
    others = rows_of_texts(texts.filter("first is null")).filter("source_pos = 0")
    return texts.filter("first is not null").select("file", F.col("first").alias("fields")).unionByName(others.select("file", "fields"))


def rows_of_texts(told: DataFrame) -> DataFrame:
    """The rows of texts, as `csv_rows` gives them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, text, mark in zip(batch["file"], batch["text"], batch["delimiter"], strict=True):
                rows = list(_records(text, mark))
                if rows:  # an empty frame has no type for its lists
                    yield pd.DataFrame({"file": file, "source_pos": range(len(rows)), "line_no": [k for k, _ in rows], "fields": [[x or None for x in f] for _, f in rows], "delimiter": mark})

    mark, over_lines = F.col("delimiter"), F.col("plain").contains(_KEPT_LINE)
    # Where no field goes over a line break, a row's line is its place.
    lines = F.transform(_lines(F.col("plain")), lambda x, i: F.struct((i + 1).cast("bigint").alias("line_no"), _fields(x, mark).alias("fields")))
    simple = told.filter(~over_lines).select("file", "delimiter", F.posexplode(F.filter(lines, lambda r: F.exists(r["fields"], lambda x: x.isNotNull()))).alias("source_pos", "r"))
    simple = simple.select("file", F.col("source_pos").cast("bigint").alias("source_pos"), "r.line_no", "r.fields", "delimiter")
    each = told.filter(over_lines).select("file", "delimiter", F.posexplode(_lines(F.col("plain"))).alias("i", "line"))
    before = Window.partitionBy("file").orderBy("i")
    inner = F.length("line") - F.length(F.replace("line", F.lit(_KEPT_LINE), F.lit("")))
    each = each.withColumns({"line_no": F.col("i") + 1 + F.coalesce(F.sum(inner).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "fields": _fields(F.col("line"), mark)})
    each = each.filter(F.exists("fields", lambda x: x.isNotNull())).select("file", (F.row_number().over(before) - 1).cast("bigint").alias("source_pos"), F.col("line_no").cast("bigint").alias("line_no"), "fields", "delimiter")
    odd = told.filter(F.col("plain").isNull()).select("file", "text", "delimiter").mapInPandas(run, "file string, source_pos long, line_no long, fields array<string>, delimiter string")
    return simple.unionByName(each).unionByName(odd)


def normalise_header(label: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(label), "[^a-z0-9 ]", ""), r"\s+", " "))


def _labels(fields: Column) -> Column:
    return F.transform(fields, lambda x: normalise_header(F.coalesce(x, F.lit(""))))


def headers(rows: DataFrame) -> DataFrame:
    """file, labels, is_header: the first row of each file. A header is a row without a date or an amount in it."""
    return told_headers(rows.filter("source_pos = 0"))


def told_headers(first: DataFrame) -> DataFrame:
    """headers() of (file, fields), the first row of each file."""
    data_like = lambda x: x.isNotNull() & (parse_date(x).isNotNull() | parse_decimal(x).isNotNull())
    return first.select("file", _labels(F.col("fields")).alias("labels"), (~F.exists("fields", data_like)).alias("is_header"))


def match_profiles(heads: DataFrame, profiles: DataFrame) -> DataFrame:
    """file, profile_id, mapping: the first profile in order whose whole signature is in the header. Profiles without one never match."""
    fits = (F.size("signature") > 0) & (F.size(F.array_except("signature", "labels")) == 0)
    found = heads.crossJoin(F.broadcast(profiles)).filter(fits)  # a handful of profiles, a row per file
    return found.groupBy("file").agg(F.min_by(F.struct("profile_id", "mapping"), "priority").alias("p")).select("file", "p.*")


def profile_by_id(profiles: DataFrame, profile_id: str) -> DataFrame:
    return profiles.filter(F.col("profile_id") == profile_id)


def profile_columns(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """file, col, dates, amounts, letters, sampled_letters, sampled: a profile of each column over the data rows."""
    return profile_data(data_rows(rows, heads))


def profile_headerless(files: DataFrame) -> DataFrame:
    """The profile of the files that have no header. Of other files only the first row is told apart from its text."""
    texts = csv_texts(files)
    bare = told_headers(first_rows(texts)).filter("not is_header").select("file")
    rows = rows_of_texts(settled(texts.drop("first").join(bare, "file", "left_semi")))
    return profile_data(rows.withColumn("data_pos", F.col("source_pos")))


def profile_data(data: DataFrame) -> DataFrame:
    """profile_columns() of numbered data rows."""
    cells = data.select("file", "data_pos", F.posexplode("fields").alias("col", "v"))
    sampled = F.col("data_pos") < SAMPLED_ROWS
    letters = F.length(F.regexp_replace(F.coalesce("v", F.lit("")), r"[^\p{L}]", ""))
    columns = (
        cells.groupBy("file", "col")
        .agg(
            F.count_if(sampled & parse_date(F.col("v")).isNotNull()).alias("dates"),
            F.count_if(sampled & parse_decimal(F.col("v")).isNotNull()).alias("amounts"),
            F.sum(letters).alias("letters"),
            F.sum(F.when(sampled, letters).otherwise(0)).alias("sampled_letters"),
            F.count_if(sampled).alias("sampled"),
        )
    )
    # Every row has a first column, so that its cells are as many as the rows looked at.
    return columns.withColumn("sampled", F.max(F.when(F.col("col") == 0, F.col("sampled"))).over(Window.partitionBy("file")))


def data_rows(rows: DataFrame, heads: DataFrame, *more: str) -> DataFrame:
    """The rows after the header, numbered from 0 in data_pos, with more columns of their file's."""
    skip = F.col("is_header").cast("int")
    return rows.join(heads.select("file", "is_header", *more), "file").filter(F.col("source_pos") >= skip).withColumn("data_pos", F.col("source_pos") - skip)


def _first_in(role: str) -> Column:
    words = F.array(*[F.lit(w) for w in HEADER_WORDS[role].split(", ")])
    hits = F.filter(F.transform("labels", lambda x, i: F.when(F.array_contains(words, x), i)), lambda i: i.isNotNull())
    return hits


def detect_mapping(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """file, mapping, confidence: HEADER_MATCH by the header's words, else CONTENT_GUESS by what the columns hold. Columns are profiled only
    where the header's words leave a part of the mapping open."""
    hits = {r: _first_in(r) for r in HEADER_WORDS}
    one = lambda r: F.try_element_at(hits[r], F.lit(1)).cast("int")
    words = heads.select("file", "is_header", "labels", *[one(r).alias(r) for r in HEADER_WORDS if r != "description"], hits["description"].cast("array<int>").alias("described"))
    ok = F.col("is_header") & F.col("date").isNotNull() & F.coalesce("amount", "debit", "credit").isNotNull() & (F.size("described") > 0)
    columns = profile_columns(rows, words.filter(~F.coalesce(ok, F.lit(False))))
    per_file = columns.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("col", "dates", "amounts", "letters", "sampled_letters"))).alias("cols"), F.first("sampled").alias("sampled"))
    base = words.join(per_file, "file", "left")

    def best(score: Column | str, keep) -> Column:
        """The column of the highest score, the first of equal ones."""
        ranked = F.transform(F.filter("cols", keep), lambda c: F.struct(c[score].alias("s"), (-c["col"]).alias("c")))
        return (-F.array_max(ranked)["c"]).cast("int")

    taken = F.array_compact(F.array("date", "amount", "debit", "credit", "balance"))
    widest = best("letters", lambda c: (c["letters"] > 0) & ~F.array_contains(taken, c["col"]))
    by_header = base.withColumn("described", F.when(F.size("described") > 0, F.col("described")).otherwise(F.array_compact(F.array(widest))))
    no_amount = F.col("amount").isNull()
    header_map = F.struct(
        F.col("date").alias("date_column"),
        F.col("described").alias("description_columns"),
        F.col("amount").alias("amount_column"),
        F.when(no_amount, F.col("debit")).alias("debit_column"),
        F.when(no_amount, F.col("credit")).alias("credit_column"),
        F.col("balance").alias("balance_column"),
        F.lit(False).alias("invert_sign"),
        F.lit(True).alias("has_header_row"),
    )
    least = F.greatest(F.floor(F.col("sampled") * 0.6), F.lit(1))
    guess = by_header.withColumn("_d", best("dates", lambda c: c["dates"] >= least))
    guess = guess.withColumn("_a", best("amounts", lambda c: (c["amounts"] >= least) & (c["col"] != F.col("_d"))))
    guess = guess.withColumn("_t", best("sampled_letters", lambda c: (c["sampled_letters"] > 0) & (c["col"] != F.col("_d")) & (c["col"] != F.col("_a"))))
    none = F.lit(None).cast("int")
    content_map = F.struct(
        F.col("_d").alias("date_column"),
        F.array("_t").alias("description_columns"),
        F.col("_a").alias("amount_column"),
        none.alias("debit_column"),
        none.alias("credit_column"),
        none.alias("balance_column"),
        F.lit(False).alias("invert_sign"),
        F.col("is_header").alias("has_header_row"),
    )
    guessed = (F.size("cols") >= 3) & F.col("_d").isNotNull() & F.col("_a").isNotNull() & F.col("_t").isNotNull()
    found = guess.select("file", F.when(ok, header_map).when(guessed, content_map).alias("m"), F.when(ok, "HEADER_MATCH").when(guessed, "CONTENT_GUESS").alias("confidence")).filter("m is not null")
    # The order of day and month from the whole date column. A file of nothing but a header has no rows here, and no mapping.
    dates = data_rows(rows, heads.join(found.select("file", "m"), "file"), "m").select("file", F.try_element_at("fields", F.col("m.date_column") + 1).alias("d"))
    order = infer_date_order(dates, F.col("d"), ["file"])
    return found.join(order, "file").select(
        "file", F.struct("m.*", F.coalesce("day_first", F.lit(False)).alias("day_first")).cast(MAPPING).alias("mapping"), "confidence"
    )


def valid_mapping(m: Column) -> Column:
    """A date, a description, and either an amount or a debit or credit column."""
    split = m["debit_column"].isNotNull() | m["credit_column"].isNotNull()
    none_below = F.least(m["date_column"], m["amount_column"], m["debit_column"], m["credit_column"], F.array_min(m["description_columns"])) >= 0
    return m["date_column"].isNotNull() & (F.size(m["description_columns"]) > 0) & (m["amount_column"].isNotNull() != split) & none_below


def required_width(m: Column) -> Column:
    """Columns that a row must have; the balance is not needed."""
    return F.array_max(F.concat(m["description_columns"], F.array_compact(F.array(m["date_column"], m["amount_column"], m["debit_column"], m["credit_column"])))) + 1


def rows_to_transactions(rows: DataFrame, mappings: DataFrame, currency: str = "USD") -> tuple[DataFrame, DataFrame]:
    """(parsed, problems) of CSV rows under the mapping of their file."""
    m = F.col("mapping")
    at = lambda i: F.try_element_at("fields", i + 1)
    data = rows.join(mappings.select("file", "mapping"), "file").filter(~m["has_header_row"] | (F.col("source_pos") > 0))
    data = with_scale(data.withColumn("currency", F.lit(currency)))
    parts = F.filter(F.transform(m["description_columns"], at), lambda x: x.isNotNull())
    amount = lambda c, invert=False: parse_amount_minor(c, F.col("minor_unit_scale"), invert)
    data = data.withColumns(
        {
            "raw_description": trimmed(F.array_join(parts, " ")),
            "_date": at(m["date_column"]),
            "_signed": amount(at(m["amount_column"]), m["invert_sign"]),
            "_debit": amount(at(m["debit_column"])),
            "_credit": amount(at(m["credit_column"])),
        }
    )
    pair = (
        F.when(F.col("_debit") != 0, -F.abs("_debit"))
        .when(F.col("_credit") != 0, F.abs("_credit"))
        .when(F.col("_debit").isNotNull() | F.col("_credit").isNotNull(), F.lit(0).cast("bigint"))
    )
    data = data.withColumns(
        {
            "posted_date": parse_date(F.col("_date"), m["day_first"]),
            "amount_minor": F.when(m["amount_column"].isNotNull(), F.col("_signed")).otherwise(pair),
            "source_location": F.concat(F.lit("line "), F.col("line_no").cast("string")),
        }
    )
    raw = F.array_join("fields", ",", "")
    say = lambda message, severity="ERROR": problem(F.col("source_location"), message, severity, raw)
    width = F.concat(F.lit("Row has "), F.size("fields").cast("string"), F.lit(" columns but the mapping needs "), required_width(m).cast("string"))
    wrong = (
        F.when(F.size("fields") < required_width(m), say(width))
        .when(F.col("raw_description") == "", say("No description"))
        .when(F.col("raw_description").rlike(SUMMARY), say("Statement summary row, not a transaction", "WARNING"))
        .when(F.col("_date").isNull(), say("Missing date"))
        .when(F.col("posted_date").isNull(), say(F.concat(F.lit("Could not read '"), F.col("_date"), F.lit("' as a date"))))
        .when(F.col("amount_minor").isNull(), say("Could not read an amount"))
    )
    read = data.withColumns({"problem": wrong, "format": F.lit("CSV"), "institution_transaction_id": F.lit(None).cast("string")})
    # Settled, as telling good rows from bad ones would parse each row's dates and amounts again, for the good ones and for the bad ones.
    return _split(settled(read.select("file", "format", "source_pos", "posted_date", "amount_minor", "currency", "raw_description", "institution_transaction_id", "source_location", "problem")))


def stated_profiles(files: DataFrame, profiles: DataFrame) -> DataFrame:
    """file, mapping: of files (file, profile_id), each file's profile by its id; an unknown id has a null mapping."""
    return files.join(F.broadcast(profiles.select("profile_id", "mapping")), "profile_id", "left").select("file", "mapping")


def csv_transactions(
    files: DataFrame, *, currency: str = "USD", profile_id: str | None = None, profiles: DataFrame | None = None, stated: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(parsed, problems): by the file's stated mapping (file, mapping; one row per file), else the stated profile, else a matching one, else
    detected columns. A stated mapping that is null or that `valid_mapping` refuses makes a problem of the file, and none of its rows
    is read."""
    spark = files.sparkSession
    profiles = profiles if profiles is not None else bank_profiles(spark)
    rows = settled(csv_rows(files))  # tokenised once, for the columns' detection and for the rows
    own = rows.limit(0).select("file", F.lit(None).cast(MAPPING).alias("mapping")) if stated is None else settled(stated.select("file", F.col("mapping").cast(MAPPING).alias("mapping")))
    others = rows if stated is None else rows.join(own.select("file"), "file", "left_anti")
    if profile_id is not None:
        mappings = others.select("file").distinct().crossJoin(F.broadcast(profile_by_id(profiles, profile_id).select("mapping")))
    else:
        heads = settled(headers(others))
        matched = settled(match_profiles(heads, profiles).select("file", "mapping"))
        # Columns are told by content only where no profile tells them.
        mappings = matched.unionByName(detect_mapping(rows, heads.join(matched, "file", "left_anti")).select("file", "mapping"))
    usable = F.coalesce(valid_mapping(F.col("mapping")), F.lit(False))
    mappings = settled(mappings.unionByName(own.filter(usable)))
    parsed, problems = rows_to_transactions(rows, mappings, currency)
    filled = rows.filter("source_pos = 0").select("file")  # once each
    if stated is not None:
        refused = _file_problem(own.filter(~usable).join(filled, "file", "left_semi"), "The stated columns cannot be used: a date, a description, and either an amount or a debit or credit column are needed")
        problems, filled = problems.unionByName(refused), filled.join(own.filter(~usable).select("file"), "file", "left_anti")
        files = files.join(own.filter(~usable).select("file"), "file", "left_anti")
    empty = _file_problem(files.select("file").join(filled, "file", "left_anti"), "No rows found")
    unmapped = _file_problem(filled.join(mappings.select("file"), "file", "left_anti"), "Could not work out which columns hold the date, description, and amount")
    return parsed, problems.unionByName(empty).unionByName(unmapped)


# -- OFX ---------------------------------------------------------------------------------------


def _tag(record: Column, tag: str) -> Column:
    """The first value of the tag that is not blank: what stands between it and the next `<`."""
    values = F.transform(F.regexp_extract_all(record, F.lit(f"(?i)<{tag}>([^<]*)"), 1), trimmed)
    return F.try_element_at(F.filter(values, lambda v: v != ""), F.lit(1))


def ofx_transactions(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parsed, problems) of OFX 1 and 2 files: one scan reads both. Adds account_mask to parsed."""
    body = F.when(F.instr("content", "<OFX>") > 0, F.expr("substring(content, instr(content, '<OFX>') + 5)")).otherwise(F.col("content"))
    first = lambda tag: F.nullif(trimmed(F.regexp_extract(F.col("body"), rf"(?i)<{tag}>([^<\r\n]*)", 1)), F.lit(""))
    code = F.upper(first("CURDEF"))
    heads = files.withColumn("body", body).select(
        "file",
        "format",
        F.coalesce(F.when(code.rlike("^[A-Z]{3}$"), code), F.lit("USD")).alias("currency"),
        F.right(first("ACCTID"), F.lit(4)).alias("account_mask"),
        F.regexp_extract_all("body", F.lit("(?s)<STMTTRN>(.*?)</STMTTRN>"), 1).alias("records"),
    )
    rows = with_scale(heads.select("file", "format", "currency", "account_mask", F.posexplode("records").alias("source_pos", "record")))
    rows = rows.withColumns({t.lower(): _tag(F.col("record"), t) for t in ("DTPOSTED", "DTUSER", "DTAVAIL", "TRNAMT", "NAME", "MEMO", "TRNTYPE", "FITID")})
    rows = rows.withColumn("_date", F.coalesce("dtposted", "dtuser", "dtavail"))
    named = F.array_join(F.array_distinct(F.array_compact(F.array("name", "memo"))), " ")
    rows = rows.withColumns(
        {
            "source_pos": F.col("source_pos").cast("bigint"),
            "posted_date": F.try_to_date(F.regexp_extract("_date", r"^(\d{8})", 1), "yyyyMMdd"),
            "amount_minor": parse_amount_minor(F.col("trnamt"), F.col("minor_unit_scale")),
            "raw_description": F.coalesce(F.nullif(named, F.lit("")), F.col("trntype"), F.lit("UNKNOWN")),
            "institution_transaction_id": F.col("fitid"),
            "source_location": F.concat(F.lit("transaction "), (F.col("source_pos") + 1).cast("string")),
        }
    )
    wrong = F.when(F.col("posted_date").isNull(), problem(F.col("source_location"), "Missing or unreadable DTPOSTED", "ERROR", F.col("_date"))).when(
        F.col("amount_minor").isNull(), problem(F.col("source_location"), "Missing or unreadable TRNAMT", "ERROR", F.col("trnamt"))
    )
    parsed, problems = _split(rows.withColumn("problem", wrong))
    none = _file_problem(heads.filter(F.size("records") == 0), "No <STMTTRN> transaction records found. The file may be an investment statement or not OFX at all.")
    return parsed, problems.unionByName(none)


def ofx_accounts(files: DataFrame) -> DataFrame:
    """file, account_mask: the last four characters of the declared account."""
    number = trimmed(F.regexp_extract("content", r"(?i)<ACCTID>([^<\r\n]*)", 1))
    return files.select("file", F.nullif(F.right(number, F.lit(4)), F.lit("")).alias("account_mask"))


# -- QIF ---------------------------------------------------------------------------------------


def qif_transactions(files: DataFrame, *, currency: str = "USD", day_first: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """(parsed, problems) of QIF files. Without a stated order, each file's dates tell whether the day comes first."""
    lines = F.filter(F.transform(F.split("content", r"\R"), trimmed), lambda x: x != "")
    each = files.select("file", "format", F.posexplode(lines).alias("pos", "line")).filter(~F.col("line").startswith("!"))
    ended = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("record", F.coalesce(F.sum(F.col("line").startswith("^").cast("int")).over(ended), F.lit(0))).filter(~F.col("line").startswith("^"))
    code, value = F.substring("line", 1, 1), trimmed(F.substring("line", 2, 1 << 20))
    of = lambda c: F.min_by(F.when(code == c, value), F.when(code == c, F.col("pos"))).alias(c)
    records = each.groupBy("file", "format", "record").agg(F.min("pos").alias("_start"), *[of(c) for c in "DTUPMN"])
    if day_first is None:
        order = infer_date_order(each.filter(code == "D").select("file", value.alias("d")), F.col("d"), ["file"])
        records = records.join(order, "file", "left").withColumn("day_first", F.coalesce("day_first", F.lit(False)))
    else:
        records = records.withColumn("day_first", F.lit(day_first))
    records = with_scale(records.withColumn("currency", F.lit(currency)))
    plain_date = F.replace(F.replace(F.col("D"), F.lit("'"), F.lit("/")), F.lit(" "), F.lit(""))
    named = F.array_join(F.array_distinct(F.filter(F.array("P", "M"), lambda x: x.isNotNull() & (x != ""))), " ")
    records = records.withColumns(
        {
            "source_pos": F.col("record").cast("bigint"),
            "posted_date": parse_date(plain_date, F.col("day_first")),
            "_amount": F.coalesce("T", "U"),
            "raw_description": F.coalesce(F.nullif(named, F.lit("")), F.concat(F.lit("CHECK "), F.col("N")), F.lit("UNKNOWN")),
            "institution_transaction_id": F.lit(None),
            "source_location": F.concat(F.lit("line "), (F.col("_start") + 1).cast("string")),
        }
    ).withColumn("amount_minor", parse_amount_minor(F.col("_amount"), F.col("minor_unit_scale")))
    wrong = F.when(F.col("posted_date").isNull(), problem(F.col("source_location"), "Missing or unreadable date (D)", "ERROR", F.col("D"))).when(
        F.col("amount_minor").isNull(), problem(F.col("source_location"), "Missing or unreadable amount (T)", "ERROR", F.col("_amount"))
    )
    parsed, problems = _split(records.withColumn("problem", wrong))
    return parsed, problems.unionByName(_file_problem(files.join(records.select("file"), "file", "left_anti"), "No QIF records found"))


# -- all ---------------------------------------------------------------------------------------


def parse_statements(files: DataFrame, *, currency: str = "USD", profile_id: str | None = None, stated: DataFrame | None = None) -> Statements:
    """Transactions and problems of files (file, content, format). stated: the columns of CSV files for which they are known."""
    files = settled(files.select("file", "content", "format"))  # read once for all formats, and for what is missing in each
    csv = csv_transactions(files.filter("format = 'CSV'"), currency=currency, profile_id=profile_id, stated=stated)
    ofx = ofx_transactions(files.filter("format in ('OFX', 'QFX')"))
    qif = qif_transactions(files.filter("format = 'QIF'"), currency=currency)
    parsed = csv[0].unionByName(ofx[0]).unionByName(qif[0])
    return Statements(parsed, csv[1].unionByName(ofx[1]).unionByName(qif[1]), files.select("file", "format"))


def read_statements(spark: SparkSession, path: str, **options) -> Statements:
    return parse_statements(read_files(spark, path), **options)


def preview(statements: Statements, n: int = 5) -> tuple[DataFrame, DataFrame]:
    """(counts per file: rows, errors, more; the first n rows of each file in source order)."""
    rows = statements.parsed.groupBy("file").agg(F.count(F.lit(1)).alias("rows"))
    errors = statements.problems.groupBy("file").agg(F.count_if(F.col("severity") == "ERROR").alias("errors"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    counts = statements.files.select("file").join(rows, "file", "left").join(errors, "file", "left")
    counts = counts.select("file", zero("rows").alias("rows"), zero("errors").alias("errors"), F.greatest(zero("rows") - n, F.lit(0).cast("bigint")).alias("more"))
    first = statements.parsed.withColumn("_n", F.row_number().over(Window.partitionBy("file").orderBy("source_pos"))).filter(F.col("_n") <= n).drop("_n")
    return counts, first
