"""Word-processor files as runs of text, one bad file never failing the job."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from maskwell.sources.text import supported

SPACE = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SEGMENTS = "path string, part int, paragraph int, seq int, text string, error string"


def runs(content: bytes) -> Iterator[tuple[int, int, int, str]]:
    """(part, paragraph, seq, text) of the body, then of headers and footers that can be read."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        more = sorted(n for n in z.namelist() if re.fullmatch(r"word/(?:header|footer)\d*\.xml", n))
        for part, name in enumerate(["word/document.xml", *more]):
            try:
                root = ElementTree.fromstring(z.read(name))
            except Exception:
                if part == 0:
                    raise
                continue
            for k, p in enumerate(root.iter(f"{SPACE}p")):
                for j, t in enumerate(p.iter(f"{SPACE}t")):
                    if t.text:
                        yield part, k, j, t.text


def read_word_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(segments, rejects): path, part, paragraph, seq, text; path, error of files that can't be read."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple] = []
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    out.extend((name, *x, None) for x in list(runs(content)))
                except Exception as e:
                    out.append((name, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "part", "paragraph", "seq", "text", "error"]).astype({"part": "Int32", "paragraph": "Int32", "seq": "Int32"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    parsed = files.filter(supported(files["path"])).select("path", "content").mapInPandas(parse, SEGMENTS)
    return parsed.filter("error is null").drop("error"), parsed.filter("error is not null").select("path", "error")
