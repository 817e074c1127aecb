"""CSV ticks or bars: header, columns, precision, clock; as typed DataFrames."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from barograph.functions.timeframes import HOUR, timeframe_ms
from barograph.operators.quality import decimals
from barograph.sources.csv_stream import PLACE_BITS

#: Names under which columns are found, lower-cased and without blanks and underscores.
TIMES = ("timestamp", "time", "datetime", "gmttime", "date")
TICK = {"bid": ("bid", "bidprice", "b"), "ask": ("ask", "askprice", "a")}
BAR = {
    "open": ("open", "o", "openprice"), "high": ("high", "h", "highprice"), "low": ("low", "l", "lowprice"), "close": ("close", "c", "closeprice"),
    "volume": ("volume", "vol", "v", "tickvolume"), "spread": ("spread", "spr"),
}
#: Layouts that the first timestamp is read in for a cross-check.
LAYOUTS = ("%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S")


@dataclass(frozen=True)
class SourceSpec:
    """What is known of a file; what is given here wins over detection."""

    kind: str = "auto"
    timestamp_col: str | None = None
    bid_col: str | None = None
    ask_col: str | None = None
    open_col: str | None = None
    high_col: str | None = None
    low_col: str | None = None
    close_col: str | None = None
    volume_col: str | None = None
    spread_col: str | None = None
    utc_offset_hours: float = 0.0
    tick_size: float | None = None
    timeframe: str | None = None
    symbol_col: str | None = None


@dataclass(frozen=True)
class Source:
    """Typed rows and what was found out about them. ``resolution_ms`` is 0 for ticks."""

    rows: DataFrame
    kind: str
    columns: dict[str, str]
    scale: int
    tick_size: float
    resolution_ms: int


def first_line(spark: SparkSession, path: str) -> str:
    first = spark.read.text(path).head()
    line = first.value.removeprefix("\ufeff") if first else ""
    if not line.strip(" \t"):
        raise ValueError(f"{path} is empty")
    return line


def separator_of(line: str) -> str:
    """A tab if the header has one, else a comma."""
    return "\t" if "\t" in line else ","


def header_of(spark: SparkSession, path: str) -> list[str]:
    line = first_line(spark, path)
    return [c.strip().strip('"') for c in line.split(separator_of(line))]


def resolve_columns(header: list[str], spec: SourceSpec, path: str = "") -> tuple[dict[str, str], str]:
    """(field -> column of the file, kind). Raises ValueError with the header if they can't be told."""
    plain = {c.lower().replace(" ", "").replace("_", ""): c for c in reversed(header)}

    def find(field: str, names: tuple[str, ...]) -> str | None:
        given = getattr(spec, f"{field}_col")
        if given and given not in header:
            raise ValueError(f"{path}: there is no column {given!r} in {header}")
        return given or next((plain[n] for n in names if n in plain), None)

    time = find("timestamp", TIMES)
    if time is None:
        raise ValueError(f"{path}: no timestamp column in {header}; name it as timestamp_col")
    found = {f: c for f, names in (TICK | BAR).items() if (c := find(f, names))}
    tick, bar = all(f in found for f in TICK), all(f in found for f in ("open", "high", "low", "close"))
    kind = spec.kind
    if kind == "auto":
        if tick == bar:
            raise ValueError(f"{path}: {'both' if tick else 'neither'} bid/ask and open/high/low/close in {header}; give kind or the columns")
        kind = "tick" if tick else "bar"
    need = list(TICK) if kind == "tick" else ["open", "high", "low", "close"]
    if missing := [f for f in need if f not in found]:
        raise ValueError(f"{path}: a {kind} source needs {', '.join(missing)}; there are {header}")
    if kind == "bar":
        need += [f for f in ("volume", "spread") if f in found]
    return {"timestamp": time} | {f: found[f] for f in need}, kind


def parse_ms(text: Column) -> Column:
    """Milliseconds of a UTC timestamp, with a blank or T between date and time, with or without a fraction; null if it has no such form."""
    return F.unix_millis(F.try_to_timestamp(F.regexp_replace(F.trim(text), "T", " ")))


def check_time(text: str, ms: int | None, path: str) -> None:
    """Hold the first parsed timestamp against Python's own reading of it."""
    for layout in LAYOUTS:
        try:
            at = datetime.strptime(text.strip(), layout).replace(tzinfo=UTC)
        except ValueError:
            continue
        if ms is None or abs(at.timestamp() * 1000 - ms) >= 1:
            raise ValueError(f"{path}: {text!r} was read as {ms} ms")
        return
    raise ValueError(f"{path}: the timestamp {text!r} has no known layout")


def scaled(price: Column, scale: int) -> Column:
    """A price as a whole number of ticks, halves to even; one that isn't finite raises."""
    bad = price.isNull() | F.isnan(price) | (F.abs(price) == float("inf"))
    return F.when(bad, F.raise_error(F.lit("a price is not finite")).cast("long")).otherwise(F.rint(price * scale).cast("long"))


def descaled(units: Column, scale: int) -> Column:
    return units / F.lit(float(scale))


def scale_of(raw: DataFrame, prices: list[str], spec: SourceSpec) -> tuple[int, float]:
    """Ticks per unit and tick size: as given, or from the most decimals that a price is written with."""
    if spec.tick_size is not None:
        scale = round(1 / spec.tick_size)
        if scale < 1 or abs(scale * spec.tick_size - 1) > 1e-12:
            raise ValueError(f"tick_size {spec.tick_size} is not one over a whole number")
        return scale, spec.tick_size
    scale = 10 ** decimals(raw, prices).first().decimals
    return scale, 1 / scale


def read_text(spark: SparkSession, path: str, header: list[str]) -> DataFrame:
    """All columns as text, so that the written precision is still there."""
    return spark.read.csv(path, header=True, sep=separator_of(first_line(spark, path)), schema=StructType([StructField(c, StringType()) for c in header]), mode="PERMISSIVE")


def layout_of(raw: DataFrame, columns: dict[str, str], spec: SourceSpec, symbol: str, scale: int | None = None) -> DataFrame:
    """symbol, seq, ms and prices of rows of text with their place ``_seq``; the clock is moved to UTC.

    Prices are put on the grid of ``scale``; without one they are taken as they are written, which is the same if the grid has
    all of their digits. One that isn't finite raises. ``digits`` is the most that a price of the row has after its point.
    """
    shift = round(spec.utc_offset_hours * HOUR)
    text = lambda f: F.col(f"`{columns[f]}`")
    price = lambda f: finite_price(text(f)) if scale is None else descaled(scaled(text(f).cast("double"), scale), scale)
    prices = [f for f in columns if f not in ("timestamp", "volume")]
    name = F.col(f"`{spec.symbol_col}`") if spec.symbol_col else F.lit(symbol)
    digits = [F.length(F.regexp_extract(text(f), r"\.([^.]*)$", 1)) for f in prices]
    return raw.select(
        name.alias("symbol"), F.col("_seq").alias("seq"), (parse_ms(text("timestamp")) - shift).alias("ms"),
        *(F.rint(text(f).cast("double")).cast("long").alias(f) if f == "volume" else price(f).alias(f) for f in columns if f != "timestamp"),
        F.greatest(*digits).alias("digits"),
    )


def finite_price(text: Column) -> Column:
    price = text.cast("double")
    bad = price.isNull() | F.isnan(price) | (F.abs(price) == float("inf"))
    return F.when(bad, F.raise_error(F.lit("a price is not finite")).cast("double")).otherwise(price)


def placed(raw: DataFrame) -> DataFrame:
    """``raw`` with ``_seq``, which grows in file order, files being taken by path.

    Above the file's number stands the byte at which a row's block begins, plus the row's number in its task: a block that isn't a
    file's last fills a task from its start, and has fewer rows than bytes.
    """
    files = sorted(raw.select(F.col("_metadata.file_path").alias("p")).distinct().toPandas()["p"]) if len(raw.inputFiles()) > 1 else []
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = raw.select(*(f"`{c}`" for c in raw.columns), F.col("_metadata.file_path").alias("_file"), (F.col("_metadata.file_block_start") + row).alias("_seq"))
    if not files:
        return rows.drop("_file")
    numbers = raw.sparkSession.createDataFrame([(f, k << PLACE_BITS) for k, f in enumerate(files)], "_file string, _number long")
    return rows.join(numbers, "_file").withColumn("_seq", F.col("_seq") + F.col("_number")).drop("_file", "_number")


def typed(raw: DataFrame, columns: dict[str, str], kind: str, scale: int, spec: SourceSpec, symbol: str) -> DataFrame:
    """symbol, seq, ms and prices on the source's grid. ``seq`` grows in file order; the clock is moved to UTC."""
    return layout_of(placed(raw), columns, spec, symbol, scale).drop("digits")


def read_csv(spark: SparkSession, path: str, spec: SourceSpec = SourceSpec(), symbol: str = "") -> Source:
    """A CSV file (or folder of files with one header) as typed rows.

    Small things meet on the driver: the header, the first timestamp, the number of decimals, the bar width. A
    bar source's width is the given timeframe or its most frequent gap.
    """
    from barograph.operators.quality import resolution

    header = header_of(spark, path)
    columns, kind = resolve_columns(header, spec, path)
    raw = read_text(spark, path, header)
    first = raw.select(F.col(f"`{columns['timestamp']}`").alias("t"), parse_ms(F.col(f"`{columns['timestamp']}`")).alias("ms")).head()
    if first is None:
        raise ValueError(f"{path} has no rows")
    check_time(first.t, first.ms, path)
    scale, tick = scale_of(raw, [f"`{c}`" for f, c in columns.items() if f not in ("timestamp", "volume")], spec)
    rows = typed(raw, columns, kind, scale, spec, symbol or Path(path).stem)
    width = 0
    if kind == "bar":
        width = timeframe_ms(spec.timeframe) if spec.timeframe else resolution(rows).first().resolution_ms
    return Source(rows, kind, columns, scale, tick, width)


def read_tick_csv(spark: SparkSession, path: str, spec: SourceSpec = SourceSpec(), symbol: str = "") -> Source:
    """A tick file; one that has bars raises."""
    source = read_csv(spark, path, spec if spec.kind != "auto" else SourceSpec(**{**spec.__dict__, "kind": "tick"}), symbol)
    if source.kind != "tick":
        raise ValueError(f"{path} is not a tick source")
    return source
