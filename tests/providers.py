"""Offline stand-ins for hosted models, for tests of the operators that take a provider."""

import numpy as np
import regex
import xxhash

TOKEN = regex.compile(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]")


class LastLine:
    """Answers with the prompt's last non-empty line; prompts above ``max_tokens`` raise."""

    def __init__(self, name="last-line", max_tokens=None):
        self.name, self.max_tokens, self.calls = name, max_tokens, 0

    def complete(self, prompts):
        if self.max_tokens is not None and any(len(TOKEN.findall(p)) > self.max_tokens for p in prompts):
            raise ValueError("prompt too long")
        lines = [[x for x in p.split("\n") if x.strip()] or [""] for p in prompts]
        return [(x[-1], len(TOKEN.findall(p)), len(TOKEN.findall(x[-1]))) for x, p in zip(lines, prompts)]


class Failing:
    name = "failing"

    def complete(self, prompts):
        raise RuntimeError("provider unavailable")


class WordCounts:
    name = "word-counts"

    def embed(self, texts):
        out = []
        for t in texts:
            v = np.zeros(256)
            for w in regex.findall(r"\w+", t.lower()):
                v[xxhash.xxh64_intdigest(w) % 256] += 1
            out.append((v / (np.linalg.norm(v) or 1)).tolist())
        return out
