"""Packed records in numpy: the layout of a file, the order of keys, and what is kept beside a written part."""

from __future__ import annotations

import bisect
import json
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs

from ..functions import codec

#: Records of a block; the index holds the first key of each.
BLOCK = 4096
#: What a folder's parts are, written last; readers go by the list of the highest number. Index files lie in their own folder.
PARTS, INDEX = "_parts-", "_index"
_LETTERS = np.array([[ord(codec.BASES[b >> s & 3]) for s in (6, 4, 2, 0)] for b in range(256)], np.uint8)

Key = tuple[int, ...]


def layout(k: int) -> np.dtype:
    """One record: little-endian words and a count."""
    return np.dtype([("w", "<u8", (codec.n_words(k),)), ("c", "<u4")])


def key_of(letters: str, k: int) -> Key:
    """The words of a k-mer or of the first k-mer with this prefix."""
    size = codec.BASES_PER_WORD
    full = letters[:k].ljust(size * codec.n_words(k), "A").translate(str.maketrans(codec.BASES, codec.DIGITS))
    return tuple(int(full[i : i + size], 4) for i in range(0, len(full), size))


def letters_of(words: np.ndarray, k: int) -> pa.Array:
    """The k-mers of an array of words (one row each), as strings."""
    flat = np.ascontiguousarray(_LETTERS[words.astype(">u8").view(np.uint8)].reshape(len(words), -1)[:, :k])
    offsets = np.arange(len(words) + 1, dtype=np.int32) * k
    return pa.StringArray.from_buffers(len(words), pa.py_buffer(offsets), pa.py_buffer(flat))


def changes(words: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it; True for the first."""
    return np.concatenate([[True], (words[1:] != words[:-1]).any(axis=1)]) if len(words) else np.zeros(0, bool)


def _less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, whether a comes before b."""
    less, equal = np.zeros(len(a), bool), np.ones(len(a), bool)
    for i in range(a.shape[1]):
        less |= equal & (a[:, i] < b[:, i])
        equal &= a[:, i] == b[:, i]
    return less


def ascending(words: np.ndarray) -> bool:
    return not _less(words[1:], words[:-1]).any()


def within(words: np.ndarray, lo: Key | None, hi: Key | None) -> np.ndarray:
    """Which rows lie in [lo, hi)."""
    keep = np.ones(len(words), bool)
    if lo is not None:
        keep &= ~_less(words, np.broadcast_to(np.array(lo, np.uint64), words.shape))
    if hi is not None:
        keep &= _less(words, np.broadcast_to(np.array(hi, np.uint64), words.shape))
    return keep


def order(words: np.ndarray) -> np.ndarray:
    """A stable order of rows by their words."""
    return np.lexsort(words.T[::-1]) if words.shape[1] > 1 else np.argsort(words[:, 0], kind="stable")


def first_at(words: np.ndarray, key: Key) -> int:
    """How many rows of ascending words are less than a key."""
    lo, hi = 0, len(words)
    for i, x in enumerate(key):
        col = words[lo:hi, i]
        lo, hi = lo + int(np.searchsorted(col, np.uint64(x), "left")), lo + int(np.searchsorted(col, np.uint64(x), "right"))
        if lo == hi:
            break
    return lo


@dataclass
class Part:
    """A written part: its records, whether they ascend, and its first and last key (none if it is empty or was not written here)."""

    name: str
    records: int
    sorted: bool = False
    first: Key | None = None
    last: Key | None = None

    def meets(self, lo: Key | None, hi: Key | None) -> bool:
        """Whether it may hold a key in [lo, hi)."""
        if self.records == 0:
            return False
        return not self.sorted or ((lo is None or self.last >= lo) and (hi is None or self.first < hi))


def to_json(parts: list[Part]) -> bytes:
    return json.dumps([asdict(p) for p in parts]).encode()


def lists(fs: pafs.FileSystem, folder: str) -> list[str]:
    """The lists of a folder, the current one last."""
    if fs.get_file_info(folder).type != pafs.FileType.Directory:
        return []
    found = fs.get_file_info(pafs.FileSelector(folder))
    return sorted(f.path for f in found if f.type == pafs.FileType.File and f.base_name.startswith(PARTS))


def next_list(lists: list[str]) -> str:
    """The name of the list that follows these. Lists are never overwritten: not every file system does that in one step."""
    n = int(lists[-1].rsplit("-", 1)[1].split(".")[0]) + 1 if lists else 0
    return f"{PARTS}{n:09d}.json"


def parts_of(fs: pafs.FileSystem, folder: str) -> list[Part] | None:
    """What the folder's current list says, or None if it has none."""
    listed = lists(fs, folder)
    if not listed:
        return None
    with fs.open_input_stream(listed[-1]) as f:
        found = json.loads(f.read())
    return [Part(p["name"], p["records"], p["sorted"], *(tuple(p[x]) if p[x] is not None else None for x in ("first", "last"))) for p in found]


def index_of(fs: pafs.FileSystem, folder: str, part: Part, k: int) -> np.ndarray:
    """First keys of a part's blocks, one row each."""
    with fs.open_input_stream(f"{folder}/{INDEX}/{part.name}") as f:
        return np.frombuffer(f.read(), "<u8").reshape(-1, codec.n_words(k))


def records_between(index: np.ndarray, part: Part, lo: Key | None, hi: Key | None) -> tuple[int, int]:
    """The records of the blocks of an ascending part that may hold keys in [lo, hi)."""
    rows = [tuple(r) for r in index.tolist()]
    # The block before the first one that starts at lo or later may end with keys from lo on.
    a = 0 if lo is None else max(0, bisect.bisect_left(rows, lo) - 1)
    b = len(rows) if hi is None else bisect.bisect_left(rows, hi)
    return a * BLOCK, min(b * BLOCK, part.records)
