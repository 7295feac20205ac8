"""WARC and WET archives, parsed as streams of records."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from millrace.plans.registry import operator


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """``(headers, body)`` of each record; header names in lower case. A record that is cut off ends the stream."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            continue
        headers: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        try:
            size = int(headers.get("content-length", ""))
        except ValueError:
            continue
        body = stream.read(size)
        if len(body) < size:
            return
        yield headers, body


def _payload(headers: dict[str, str], body: bytes) -> bytes:
    """What follows the HTTP headers, where the record holds an HTTP message."""
    if "application/http" in headers.get("content-type", "").lower() or body.startswith(b"HTTP/"):
        return body.partition(b"\r\n\r\n")[2] if b"\r\n\r\n" in body else body.partition(b"\n\n")[2]
    return body


@operator("warc_wet_reader", "source")
def warc_wet_reader(spark: SparkSession, input_path: str, types: list[str]) -> DataFrame:
    """``url, content`` of the records of the given types (such as response, conversion), gzipped or not.

    A record's length is taken from its header. Payloads that are not UTF-8 are left out.
    """
    wanted = {t.lower() for t in types}

    def run(batches):
        for b in batches:
            for raw in b.column(0):
                data = raw.as_buffer()
                stream = io.BufferedReader(pa.BufferReader(data), 1 << 20)
                if bytes(memoryview(data)[:2]) == b"\x1f\x8b":
                    stream = gzip.GzipFile(fileobj=stream)
                urls, texts, held = [], [], 0
                for headers, body in records(stream):
                    if headers.get("warc-type", "").lower() not in wanted:
                        continue
                    try:
                        text = _payload(headers, body).decode("utf-8")
                    except UnicodeDecodeError:
                        continue
                    urls.append(headers.get("warc-target-uri"))
                    texts.append(text)
                    held += len(body)
                    if held > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(urls, pa.string()), pa.array(texts, pa.string())], names=["url", "content"])
                        urls, texts, held = [], [], 0
                if urls:
                    yield pa.RecordBatch.from_arrays([pa.array(urls, pa.string()), pa.array(texts, pa.string())], names=["url", "content"])

    return spark.read.format("binaryFile").load(input_path).select("content").mapInArrow(run, "url string, content string")
