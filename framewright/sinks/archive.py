"""ZIP archives from rows: the pieces of an archive are rows, so no task holds one.

Files are stored as they are. Checksums and sizes are columns, places in the archive running sums over slices; what appends the pieces one by one writes the
archive. Without the larger format an archive has less than 65,535 files and less than 4 GiB, and what is beyond that is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.slices import Running, running, sliced

# Fixed values of the format: the marks of a file, of its entry in the directory and of the directory's end; the version that reads it; flag of UTF-8 names; the first day of 1980.
FILE, ENTRY, END = "504B0304", "504B0102", "504B0506"
VERSION, UTF8, TIME, DAY = 20, 1 << 11, 0, 33


def _low_first(*fields: tuple[Column | int, int]) -> Column:
    """Numbers as hexadecimal digits of so many bytes each, the lowest byte first."""
    digits = []
    for n, size in fields:
        n = F.lit(n) if isinstance(n, int) else n
        digits += [F.lpad(F.hex(F.pmod(F.floor(n / (1 << 8 * k)), F.lit(256))), 2, "0") for k in range(size)]
    return F.concat(*digits)


def zip_pieces(files: DataFrame, key: str, name: str = "name", place: str = "place") -> DataFrame:
    """(key, place, content) for files (key, name, place, content): laid one after another by place, a struct, they are an archive for each key with its files by place."""
    own = files.select(F.col(key).alias("key"), F.encode(F.col(name), "UTF-8").alias("name"), F.col(place).alias("at"), F.coalesce("content", F.lit(b"")).alias("content"))
    own = own.withColumns({"size": F.length("content").cast("long"), "crc": F.crc32("content"), "named": F.length("name").cast("long")})
    line = running(sliced(own, "key", ["at"]), "key", ["at"], {"n": Running("count", F.lit(1)), "offset": Running("sum", 30 + F.col("named") + F.col("size"))})
    told = ((VERSION, 2), (UTF8, 2), (0, 2), (TIME, 2), (DAY, 2), (F.col("crc"), 4), (F.col("size"), 4), (F.col("size"), 4), (F.col("named"), 2), (0, 2))
    body = F.concat(F.unhex(F.concat(F.lit(FILE), _low_first(*told))), "name", "content")
    entry = F.concat(F.unhex(F.concat(F.lit(ENTRY), _low_first((VERSION, 2), *told, (0, 2), (0, 2), (0, 2), (0, 4), (F.col("offset"), 4)))), "name")
    piece = lambda part, content: F.struct(F.struct(F.lit(part).alias("part"), F.col("n").alias("n")).alias("place"), content.alias("content"))
    pieces = line.select("key", F.explode(F.array(piece(0, body), piece(1, entry))).alias("p")).select("key", "p.*")
    sums = line.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(30 + F.col("named") + F.col("size")).alias("begin"), F.sum(46 + F.col("named")).alias("size"))
    fits = (F.col("n") < (1 << 16) - 1) & (F.col("begin") + F.col("size") < (1 << 32) - 1)
    end = F.unhex(F.concat(F.lit(END), _low_first((0, 2), (0, 2), (F.col("n"), 2), (F.col("n"), 2), (F.col("size"), 4), (F.col("begin"), 4), (0, 2))))
    ends = sums.select("key", F.struct(F.lit(2).alias("part"), F.lit(0).cast("long").alias("n")).alias("place"), F.when(fits, end).otherwise(F.raise_error(F.lit("an archive of this kind has less than 65,535 files and 4 GiB"))).alias("content"))
    return pieces.unionByName(ends).withColumnRenamed("key", key)
