"""The contract of a scoring request, without a server: what is valid, and what is answered."""

from __future__ import annotations

from collections.abc import Callable

from lumenrank.functions import constants as K


class RequestError(Exception):
    def __init__(self, status: int, detail: str):
        super().__init__(detail)
        self.status = status


def health(model: object | None) -> dict:
    return {"status": "ok", "model_loaded": model is not None}


def score(peptide: str, model: Callable[[str], float] | None) -> dict:
    """400 for a sequence that cannot be scored, 503 without a model."""
    p = peptide.strip().upper()
    if len(p) not in K.LENGTHS or set(p) - set(K.RESIDUES):
        raise RequestError(400, f"a sequence has {min(K.LENGTHS)} to {max(K.LENGTHS)} standard residues")
    if model is None:
        raise RequestError(503, "no model is loaded")
    return {"peptide": p, "score": float(model(p))}
