"""Documents from the lines of files by a table function: state goes along a file's lines, rows come as blocks end."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.functions import udtf


@udtf(returnType="path string, block int, head string, body string")
class Blocks:
    """Lines (path, line_no, line) of one file in order -> its blocks. A line that begins with ``head: `` begins a block; lines
    after it are its body, until a blank line or the end of the file. Other lines belong to no block."""

    def __init__(self) -> None:
        self.path, self.n, self.head, self.body = None, 0, None, []

    def _ended(self) -> Iterator[tuple]:
        if self.head is not None:
            yield self.path, self.n, self.head, "\n".join(self.body).strip()
            self.n += 1
        self.head, self.body = None, []

    def eval(self, row: Row, head: str) -> Iterator[tuple]:
        line, mark = row["line"] or "", f"{head}: "
        self.path = row["path"]
        if line.startswith(mark):
            yield from self._ended()
            self.head = line[len(mark) :].strip()
        elif not line:
            yield from self._ended()
        elif self.head is not None:
            self.body.append(line)

    def terminate(self) -> Iterator[tuple]:
        yield from self._ended()


def blocks(lines: DataFrame, head: str) -> DataFrame:
    """lines (path, line_no, line) -> (path, block, head, body) of all files; a file's lines are one partition, in order,
    and go through one at a time. A null line is a blank one."""
    spark = lines.sparkSession
    spark.udtf.register("line_blocks", Blocks)
    return spark.sql("SELECT path, block, head, body FROM line_blocks(TABLE(SELECT path, line_no, line FROM {lines}) PARTITION BY (path) ORDER BY (line_no), {head})", lines=lines, head=head)
