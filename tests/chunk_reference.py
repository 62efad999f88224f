"""Chunks of a text in plain Python, for comparison."""

import re
from collections.abc import Iterator


def _pieces(text: str, size: int) -> Iterator[tuple[int, str, str]]:
    """(run, joint, piece) in order: whole paragraphs, sentences of paragraphs beyond the size, slices of sentences beyond
    it. Only pieces of one run may share a chunk: neighbouring short paragraphs, or neighbouring sentences of one long
    paragraph; a slice stands alone."""
    run = 0
    for block in map(str.strip, re.split(r"\n{2,}", text)):
        if len(block) <= size:
            if block:
                yield run, "\n\n", block
            continue
        run += 1
        for sentence in re.split(r"(?<=[.!?。！？\n])\s+", block):
            slices = [sentence[i : i + size] for i in range(0, len(sentence), size)]
            for piece in slices:
                run += len(slices) > 1
                yield run, " ", piece
            run += len(slices) > 1
        run += 1


def split_chunks(text: str | None, size: int) -> list[str]:
    """A text's pieces, each put behind the one before it while they are of one run and the chunk holds both."""
    chunks: list[str] = []
    last = -1
    for run, joint, piece in _pieces(text or "", size):
        if run == last and len(chunks[-1]) + len(joint) + len(piece) <= size:
            chunks[-1] += joint + piece
        else:
            chunks.append(piece)
        last = run
    return chunks
