"""Raw payloads to rows (R operators)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.scalars import first_non_blank

# Field aliases of extracted tables, delimiters, image pattern, first data day by type.
EXTRACTED_ALIASES = {
    "stock_name": ("stock_name", "个股", "公司", "标的"),
    "theme_path": ("theme_path", "theme", "topic", "主题"),
    "relation": ("relation", "relevance", "相关性", "说明", "业务说明"),
    "source": ("source", "信源", "资料来源", "来源"),
}
PATH_DELIMITER = ","
PATH_SEPARATORS = " > |>|，|、"
IMAGE_PATTERN = "(?i)https?://[^\\s\"'<>]+?\\.(?:png|jpe?g)(?:\\?[^\\s\"'<>]*)?"
LINK_PATTERN = "https?://[^\\s\"'<>]+"
TYPE_START_DATES = {"1": "1990-12-19", "2": "2006-01-01", "5": "2026-01-05"}


def flatten_grouped_events(
    df: DataFrame, payload: str, schema: str, items: str, nested: Sequence[str] = (), columns: Sequence[str] = ()
) -> DataFrame:
    """Page, groups, items and an optional nested struct as flat rows.

    ``schema`` describes one group. Parent columns repeat on every item; the item's own value wins
    where it has one, and the nested struct's over both. ``nested`` is the path below an item.
    """
    parsed = df.select(F.explode(F.from_json(payload, f"array<{schema}>")).alias("g")).select(
        "g", F.explode(F.col("g")[items]).alias("i")
    )
    group_type = parsed.schema["g"].dataType
    item_type = parsed.schema["i"].dataType
    inner_type, inner = item_type, F.col("i")
    for step in nested:
        inner_type, inner = inner_type[step].dataType, inner[step]

    def pick(name: str) -> Column:
        sources = []
        if nested and name in inner_type.names:
            sources.append(inner[name])
        if name in item_type.names:
            sources.append(F.col("i")[name])
        if name in group_type.names:
            sources.append(F.col("g")[name])
        return F.coalesce(*sources)

    return parsed.select(*[pick(c).alias(c) for c in columns])


def flatten_pages(df: DataFrame, payload: str, schema: str, items: str = "info", carry: Sequence[str] = ("date",)) -> DataFrame:
    """Pages as rows of their items with page-level columns (R02); a page without items gives one NULL row."""
    page = df.select(F.from_json(payload, schema).alias("p"))
    rows = page.select(*[F.col("p")[c].alias(c) for c in carry], F.explode_outer(F.col("p")[items]).alias("i"))
    return rows.select(*carry, "i.*")


def leaf_columns(fields: Sequence[T.StructField], root: Callable[[str], Column]) -> dict[str, tuple[Column, T.DataType]]:
    """Leaves of all structs by their own names, with their types; arrays of objects become parallel arrays."""
    found: dict[str, tuple[Column, T.DataType]] = {}

    def visit(path: Column, data_type: T.DataType, name: str) -> None:
        if isinstance(data_type, T.StructType):
            for f in data_type.fields:
                visit(path[f.name], f.dataType, f.name)
        elif isinstance(data_type, T.ArrayType) and isinstance(data_type.elementType, T.StructType):
            for leaf, kind, getter in struct_leaves(data_type.elementType):
                found[leaf] = F.transform(path, getter), T.ArrayType(kind)
        else:
            found[name] = path, data_type

    for f in fields:
        visit(root(f.name), f.dataType, f.name)
    return found


def flatten_struct(df: DataFrame) -> DataFrame:
    """Leaves of all structs under their own names; arrays of objects become parallel arrays."""
    return df.select(*[c.alias(n) for n, (c, _) in leaf_columns(df.schema.fields, F.col).items()])


def flatten_payload(df: DataFrame, payload: str, keep: Sequence[str] = ()) -> DataFrame:
    """Leaves of JSON objects of any shape under their own names, without a schema given.

    The shapes of all rows are merged in one aggregate over VARIANT values; what that finds is read
    as structs and flattened as ``flatten_struct`` does. A leaf that is not of one type in all rows is
    JSON text. Texts that are no JSON object have NULL leaves; of equal leaf names the last in order of
    path stands, and a leaf replaces no column of ``keep``.
    """
    parsed = df.select(*keep, F.try_parse_json(payload).alias("_v"))
    is_object = F.schema_of_variant("_v").startswith("OBJECT")
    shape = parsed.where(is_object).agg(F.schema_of_variant_agg("_v")).first()[0]
    if not shape.startswith("OBJECT<") or shape == "OBJECT<>":
        return parsed.select(*keep)
    typed = shape.replace("OBJECT<>", "STRING").replace("OBJECT<", "STRUCT<").replace("VOID", "STRING")
    read = parsed.select(*keep, F.when(is_object, F.variant_get("_v", "$", typed)).alias("_o"))
    leaves = leaf_columns(read.schema["_o"].dataType.fields, lambda name: F.col("_o")[name])
    mixed = {n for n, (_, kind) in leaves.items() if "variant" in kind.simpleString()}
    return read.select(*keep, *[(F.to_json(c) if n in mixed else c).alias(n) for n, (c, _) in leaves.items() if n not in keep])


def struct_leaves(struct: T.StructType, steps: tuple[str, ...] = ()):
    for f in struct.fields:
        path = (*steps, f.name)
        if isinstance(f.dataType, T.StructType):
            yield from struct_leaves(f.dataType, path)
        else:
            yield f.name, f.dataType, follow(path)


def follow(path: tuple[str, ...]):
    """Getter of one leaf below an array element."""

    def getter(x):
        for step in path:
            x = x[step]
        return x

    return getter


def unknown_fields(df: DataFrame, payload: str, allowed: Sequence[str]) -> DataFrame:
    """Fields outside the contract, counted over all rows."""
    extra = F.array_except(F.json_object_keys(payload), F.array(*[F.lit(a) for a in allowed]))
    return df.agg(
        F.sum(F.coalesce(F.size(extra), F.lit(0))).alias("unknown_field_count"),
        F.count_if(F.json_object_keys(payload).isNull()).alias("not_an_object_count"),
    )


def normalize_yield_curve(
    df: DataFrame, tenors: dict[str, str], curve: str, year: int | None = None, strict: bool = True,
    date: str = "work_date", curve_column: str = "curve_name",
) -> DataFrame:
    """Curve rows under our tenor names.

    Another curve, another year, a repeated date and text that is no number are contract breaks: an
    error in strict mode. Otherwise such rows are left out, one row per date stays, and the number is NULL.
    """
    wrong_curve = ~F.col(curve_column).eqNullSafe(F.lit(curve))
    wrong_year = (F.year(date) != year) if year is not None else F.lit(False)
    def value(source: str) -> Column:
        text = F.nullif(F.trim(F.col(source).cast("string")), F.lit(""))
        number = text.try_cast("double")
        if strict:
            bad = F.raise_error(F.concat(F.lit(f"{source} is not a number: "), text)).cast("double")
            number = F.when(text.isNotNull() & number.isNull(), bad).otherwise(number)
        return number

    values = [value(s).alias(n) for s, n in tenors.items()]
    if strict:
        guarded = df.withColumn(
            date, F.when(wrong_curve | wrong_year, F.raise_error(F.lit("row of another curve or year")).cast("date")).otherwise(F.col(date))
        ).select(F.col(date), F.col(curve_column), *values)
        repeated = guarded.groupBy(date, curve_column).agg(
            F.count(F.lit(1)).alias("_n"), *[F.max(n).alias(n) for n in tenors.values()]
        )
        one = F.when(F.col("_n") == 1, F.col(date)).otherwise(F.raise_error(F.lit("date repeated in the curve")).cast("date"))
        return repeated.select(one.alias(date), curve_column, *tenors.values())
    kept = df.where(~(wrong_curve | wrong_year)).select(date, curve_column, *values)
    return kept.groupBy(date, curve_column).agg(*[F.max(n).alias(n) for n in tenors.values()])


def clean_path(text: Column) -> Column:
    """Path text with one delimiter, parts trimmed, empty parts left out."""
    unified = F.regexp_replace(F.trim(text), PATH_SEPARATORS, PATH_DELIMITER)
    parts = F.filter(F.transform(F.split(unified, PATH_DELIMITER), lambda p: F.trim(p)), lambda p: p != "")
    return F.array_join(parts, PATH_DELIMITER)


def normalize_extracted_rows(
    df: DataFrame, payload: str, keys: Sequence[str], aliases: dict[str, Sequence[str]] | None = None, path_field: str = "theme_path"
) -> DataFrame:
    """Extracted table rows: aliases resolved, texts trimmed, paths unified, blanks and repeats dropped."""
    aliases = aliases or EXTRACTED_ALIASES
    rows = df.select(*keys, F.explode(F.from_json(payload, "array<map<string,string>>")).alias("m"))

    def field(name: str) -> Column:
        chosen = F.coalesce(
            first_non_blank(*[F.trim(F.col("m")[a]) for a in aliases[name]]), F.lit("")
        )
        return clean_path(chosen) if name == path_field else chosen

    named = rows.select(*keys, *[field(n).alias(n) for n in aliases])
    filled = F.concat(*[F.col(n) for n in aliases]) != ""
    return named.where(filled).dropDuplicates([*keys, *aliases])


def assemble_snapshot(df: DataFrame, object_col: str, index_col: str, rows_col: str, control: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of all objects with object name, object index and row index, and the totals that differ
    from the control counts (R09)."""
    rows = df.select(object_col, index_col, F.posexplode(rows_col).alias("row_index", "row_value"))
    found = rows.groupBy(object_col).agg(F.count(F.lit(1)).alias("found_rows"))
    totals = control.join(found, object_col, "full_outer").select(
        object_col, F.coalesce("expected_rows", F.lit(0)).alias("expected_rows"), F.coalesce("found_rows", F.lit(0)).alias("found_rows")
    ).where("expected_rows <> found_rows")
    return rows, totals


def extract_urls(df: DataFrame, column: str, keys: Sequence[str], pattern: str = IMAGE_PATTERN) -> DataFrame:
    """Distinct URLs of a text and a file name for each: the path's tail, else a hash."""
    urls = F.array_distinct(F.transform(F.regexp_extract_all(column, F.lit(pattern), F.lit(0)), lambda u: F.trim(u)))
    exploded = df.select(*keys, F.explode(urls).alias("url"))
    tail = F.regexp_extract(F.regexp_extract("url", "^https?://[^/?#]*([^?#]*)", 1), "([^/]*)$", 1)
    return exploded.select(
        *keys, "url", F.when(tail.isin("", ".", ".."), F.concat(F.sha2("url", 256), F.lit(".img"))).otherwise(tail).alias("file_name")
    )


def page_duplicates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Whole rows that occur on more than one page."""
    columns = list(columns or df.columns)
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("row_count")).where("row_count > 1")


def active_ranges(
    basics: DataFrame, start: str, end: str, types: dict[str, str] = TYPE_START_DATES, allowed: Sequence[str] = ("1", "2")
) -> DataFrame:
    """Part of a requested range in which each security is listed and its type has data."""
    kind = F.col("type").cast("string")
    first = F.lit(None).cast("date")
    for t in allowed:
        if t in types:
            first = F.when(kind == t, F.lit(types[t]).cast("date")).otherwise(first)
    begin = F.greatest(F.lit(start).cast("date"), F.greatest(F.col("ipoDate"), first))
    finish = F.least(F.lit(end).cast("date"), F.col("outDate"))
    usable = first.isNotNull() & F.col("ipoDate").isNotNull() & (F.col("outDate").isNull() | (F.col("outDate") >= F.col("ipoDate")))
    return basics.where(usable).select(
        "code", kind.alias("security_type"), begin.alias("start_date"), finish.alias("end_date")
    ).where("start_date <= end_date")


def counts_by(df: DataFrame, column: str) -> DataFrame:
    """Rows per value."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("row_count"))


def select_trade_dates(dates: DataFrame, calendar: DataFrame, max_n: int, date: str = "trade_date") -> tuple[DataFrame, DataFrame]:
    """Latest ``max_n`` requested trading days, and what was skipped with the reason."""
    wanted = dates.select(date).distinct()
    days = calendar.select(date).distinct()
    trading = wanted.join(days, date, "left_semi")
    kept = trading.orderBy(F.col(date).desc()).limit(max_n)
    skipped = wanted.join(days, date, "left_anti").withColumn("reason", F.lit("not_a_trading_day")).unionByName(
        trading.join(kept, date, "left_anti").withColumn("reason", F.lit("over_limit"))
    )
    return kept, skipped
