"""Vocabularies of public tokenizers, and a longest-match automaton over their pieces.

The automaton is a trie of the pieces. Each node has a failure link to the node of what is
left after greedily popping pieces from the node's string, with the number of the popped
tokens (and their ids) computed beforehand, so a text's greedy longest-match length comes
from one pass over its characters: no piece is built and no character read twice.

A character that no piece covers counts as its UTF-8 bytes (byte fallback).
"""

from __future__ import annotations

import gc
from array import array
from collections import deque

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"


class Pieces:
    """Pieces of a SentencePiece model: ``text`` id -> piece, ``rank`` id -> merge order."""

    def __init__(self, path: str = PIECES) -> None:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = p.get_piece_size()
        self.size = n
        self.text = [p.id_to_piece(i) for i in range(n)]
        self.special = [p.is_control(i) or p.is_unknown(i) or p.is_unused(i) for i in range(n)]
        self.bytes = {int(t[3:5], 16): i for i, t in enumerate(self.text) if p.is_byte(i)}
        self.normal = {t: i for i, t in enumerate(self.text) if not self.special[i] and not p.is_byte(i)}
        self.score = [p.get_score(i) for i in range(n)]
        if len(self.bytes) != 256:
            raise ValueError("the vocabulary has no byte pieces, so it couldn't stand for every text")


class LongestMatch:
    """Greedy longest-match tokenisation of single words (``count``, ``ids``) with memo."""

    def __init__(self, pieces: dict[str, int], bytes_: dict[int, int], memo_words: int = 1_000_000) -> None:
        self.bytes, self.memo_words = bytes_, memo_words
        self.counts: dict[str, int] = {}
        child: list[dict[str, int]] = [{}]
        token = [-1]
        for text, i in pieces.items():
            v = 0
            for ch in text:
                u = child[v].get(ch)
                if u is None:
                    u = child[v][ch] = len(child)
                    child.append({})
                    token.append(-1)
                v = u
            token[v] = i
        n = len(child)
        fail, popped, ids = array("i", [0]) * n, array("i", [0]) * n, [()] * n
        queue = deque((0, ch, v) for ch, v in child[0].items())
        while queue:
            u, ch, v = queue.popleft()
            queue.extend((v, c, w) for c, w in child[v].items())
            if token[v] >= 0:
                popped[v], ids[v] = 1, (token[v],)
                continue
            z, out = u, []
            if u:
                z, out = fail[u], list(ids[u])
            while z and ch not in child[z]:
                out += ids[z]
                z = fail[z]
            if ch in child[z] and child[z][ch] != v:
                fail[v] = child[z][ch]
            else:  # the character begins no piece
                out += self._fallback(ch)
            popped[v], ids[v] = len(out), tuple(out)
        self.child, self.fail, self.popped, self.popped_ids = child, fail, popped, ids

    def _fallback(self, ch: str) -> list[int]:
        return [self.bytes[b] for b in ch.encode("utf-8", "surrogatepass")]

    def count(self, word: str) -> int:
        """The number of tokens of a word, without its tokens."""
        n = self.counts.get(word)
        if n is not None:
            return n
        child, fail, popped, v, n = self.child, self.fail, self.popped, 0, 0
        for ch in word:
            u = child[v].get(ch)
            while u is None and v:
                n += popped[v]
                v = fail[v]
                u = child[v].get(ch)
            if u is None:
                n += len(ch.encode("utf-8", "surrogatepass"))
            else:
                v = u
        while v:
            n += popped[v]
            v = fail[v]
        if len(word) <= 64:
            if len(self.counts) >= self.memo_words:
                self.counts.clear()
            self.counts[word] = n
        return n

    def ids(self, word: str) -> list[int]:
        child, fail, v, out = self.child, self.fail, 0, []
        for ch in word:
            u = child[v].get(ch)
            while u is None and v:
                out += self.popped_ids[v]
                v = fail[v]
                u = child[v].get(ch)
            if u is None:
                out += self._fallback(ch)
            else:
                v = u
        while v:
            out += self.popped_ids[v]
            v = fail[v]
        return out


_PIECES: dict[str, Pieces] = {}
_LOADED: dict[str, tuple[Pieces, LongestMatch]] = {}


def pieces(path: str = PIECES) -> Pieces:
    """One vocabulary a worker process and path."""
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def loaded(path: str = PIECES) -> tuple[Pieces, LongestMatch]:
    """The vocabulary with its automaton, which only longest matching needs."""
    if path not in _LOADED:
        p = pieces(path)
        _LOADED[path] = p, LongestMatch(p.normal, p.bytes)
        settled()
    return _LOADED[path]


def settled() -> None:
    """Keeps what was loaded for good out of the collector's way, which would go through all of it at every task."""
    gc.collect()
    gc.freeze()
