"""URL filter: a sorted array of 64-bit digests, memory-mapped and probed by binary search.

The keys of all rules, host and path prefix, are hashed with XXH64 and sorted. Each url is cut into
its candidate keys (each parent domain with each rule length of its path); one vectorised search
finds the digests, and the rule's full string, stored beside them, confirms that it is no collision.
"""

from __future__ import annotations

import io
import shutil
import tarfile
import uuid
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm.common import map_batches, write_shared

#: (verdict, host/path prefix)
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
DEFAULT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def digest_array(rules: list[tuple[str, str]]) -> dict[str, np.ndarray]:
    """The parts of a digest array: sorted keys, and in their order the ends of the rule strings, the strings, the verdicts; the lengths that rules' paths have, and the numbers of labels that their hosts have.

    A rule given twice must have one verdict. A host is everything before the first /.
    """
    given: dict[str, str] = {}
    for verdict, rule in rules:
        if given.setdefault(rule, verdict) != verdict or verdict not in ("allow", "block") or "/" not in rule:
            raise ValueError(f"rule {rule!r} has two verdicts, an unknown one or no path")
    names = sorted(given)
    keys = np.array([xxhash.xxh64_intdigest(r.encode()) for r in names], np.uint64)
    order = np.argsort(keys, kind="stable")
    names = [names[i] for i in order]
    return {
        "keys": keys[order],
        "ends": np.cumsum([len(r.encode()) for r in names], dtype=np.int64),
        "strings": np.frombuffer("".join(names).encode(), np.uint8),
        "blocked": np.array([given[r] == "block" for r in names], bool),
        "lengths": np.unique([len(r) - r.index("/") for r in names]).astype(np.int64),
        "labels": np.unique([r[: r.index("/")].count(".") + 1 for r in names]).astype(np.int64),
    }


_PARTS = ("keys", "ends", "strings", "blocked", "lengths", "labels")


class DigestArray:
    """A digest array's parts, as arrays or as the files of a folder, memory-mapped."""

    def __init__(self, at: Path | dict[str, np.ndarray]):
        part = at if isinstance(at, dict) else {n: np.load(at / f"{n}.npy", mmap_mode="r") for n in _PARTS}
        self.keys, self.ends, self.strings, self.blocked, self.lengths, self.labels = (part[n] for n in _PARTS)

    def rule(self, i: int) -> bytes:
        return self.strings[self.ends[i - 1] if i else 0 : self.ends[i]].tobytes()

    def probe(self, candidates: list[bytes]) -> np.ndarray:
        """Number of the rule that equals each candidate, or -1: a search for all digests at once, then a comparison of the strings, also of further rules with the same digest."""
        out = np.full(len(candidates), -1, np.int64)
        if not candidates or not len(self.keys):
            return out
        digests = np.fromiter(map(xxhash.xxh64_intdigest, candidates), np.uint64, len(candidates))
        at = np.searchsorted(self.keys, digests)
        for c in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == digests):
            i = int(at[c])
            while i < len(self.keys) and self.keys[i] == digests[c]:
                if self.rule(i) == candidates[c]:
                    out[c] = i
                    break
                i += 1
        return out


@cache
def _opened(name: str) -> DigestArray:
    folder = Path(SparkFiles.get(name))
    unpacked = folder.with_suffix("")
    if not unpacked.is_dir():
        part = Path(f"{unpacked}-{uuid.uuid4().hex}")
        shutil.unpack_archive(folder, part)
        try:
            part.rename(unpacked)
        except OSError:  # another worker of this executor was first
            shutil.rmtree(part)
    return DigestArray(unpacked)


def publish(spark: SparkSession, rules: list[tuple[str, str]]) -> str:
    """Builds the array on the driver, writes it to the shared folder and has every executor fetch a copy, which it maps; returns its name."""
    packed = io.BytesIO()
    with tarfile.open(fileobj=packed, mode="w") as tar:
        for name, part in digest_array(rules).items():
            body = io.BytesIO()
            np.save(body, part)
            entry = tarfile.TarInfo(f"{name}.npy")
            entry.size = body.tell()
            body.seek(0)
            tar.addfile(entry, body)
    name = f"digests-{uuid.uuid4().hex}.tar"
    spark.sparkContext.addFile(write_shared(spark, name, packed.getvalue()))
    return name


def candidates(host: str, path: str, lengths: list[int], labels: list[int]) -> list[str]:
    """The host's parent domains, itself included, of these numbers of labels, each with the path's beginning of each of these lengths: rules of others can't fit."""
    parts = host.rsplit(".", max(labels, default=0))
    hosts = [".".join(parts[len(parts) - n :]) for n in labels if n <= len(parts)] if labels else []
    return [f"{h}{path[:n]}" for n in lengths if n <= len(path) for h in hosts]


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str]] = RULES, default: str = DEFAULT) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages.

    A rule fits its host and all subdomains if the path starts with the rule's; of several the longest
    wins, of equally long ones that of the longer host. Without a rule: rule null, and the default verdict. Null, empty and malformed urls have an
    empty host and path. Hosts and paths may be of any length. Repeated rows stay. Other columns are not read. An empty
    table gives no rows.
    """
    name = publish(pages.sparkSession, rules)
    url = F.col(url_col)
    named = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        array = _opened(name)
        lengths, labels = array.lengths.tolist(), array.labels.tolist()
        sets = [candidates(h, p, lengths, labels) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        hits = array.probe([c.encode("utf-8", "surrogatepass") for s in sets for c in s]).tolist()
        found, verdicts, at = [], [], 0
        for s in sets:
            best = max((i for i in hits[at : at + len(s)] if i >= 0), key=lambda i: (len(array.rule(i)), array.rule(i).index(b"/")), default=None)
            at += len(s)
            found.append(None if best is None else array.rule(best).decode())
            verdicts.append(default if best is None else "block" if array.blocked[best] else "allow")
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(verdicts, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return map_batches(named, run, f"page_id {named.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, verdict string")
