"""DOCX paragraph text, extracted batch by batch on the executors."""

from __future__ import annotations

import io
import sys
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from .records import small_batches

# Workers get this module's code with the task and need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_MARKS = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n", f"{_W}noBreakHyphen": "-"}


def _run_text(run: ElementTree.Element) -> str:
    return "".join((node.text or "") if node.tag == f"{_W}t" else _MARKS.get(node.tag, "") for node in run)


def _paragraph_text(paragraph: ElementTree.Element) -> str:
    runs = paragraph.iterfind(f"{_W}r"), paragraph.iterfind(f"{_W}hyperlink/{_W}r")
    wanted = {run for found in runs for run in found}
    return "".join(_run_text(run) for run in paragraph.iter(f"{_W}r") if run in wanted)


def docx_text(data: bytes) -> str:
    """Paragraphs of the document body joined by newlines."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        root = ElementTree.fromstring(archive.read("word/document.xml"))
    return "\n".join(_paragraph_text(p) for p in root.iterfind(f"{_W}body/{_W}p"))


def document_text(path: str, data: bytes) -> str | None:
    """The text of a document; None for other files."""
    return docx_text(data) if path.lower().endswith(".docx") else None


def extract_documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Replace the column ``content`` by ``text`` and ``error``."""
    for batch in batches:
        results = []
        for data in batch["content"]:
            try:
                results.append((docx_text(data), None))
            except Exception as exc:  # a broken document is a failed source, not a failed scan
                results.append((None, f"{type(exc).__name__}: {exc}"))
        found = pd.DataFrame(results, columns=["text", "error"], index=batch.index, dtype=object)
        yield batch.drop(columns="content").join(found)


def extracted(files: DataFrame, schema: str) -> DataFrame:
    """``extract_documents`` over rows with a column ``content``; ``schema`` is that of the result. A worker holds a small batch of documents, not 10,000 of them."""
    return small_batches(files).mapInPandas(extract_documents, schema)
