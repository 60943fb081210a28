"""Parameters of a dictionary."""

from __future__ import annotations

from dataclasses import asdict, dataclass

VERSION = (1, 0, 0)

# The default two-bit order of bases, and the alphabetic one.
ALPHABETS = {"default": "ACTG", "traditional": "ACGT"}
COMPLEMENT = {"default": 2, "traditional": 3}  # which bits of a base's code differ from its complement's
MAX_K = 63


@dataclass(frozen=True)
class Config:
    """k-mer length, minimizer length, hash seed, mode and alphabet.

    ``canonical`` decides only the orientation reported for palindromes of even k, and which m-mer represents a k-mer in
    the minimizer statistics; lookups always use one key for both strands.
    """

    k: int = 31
    m: int = 20
    seed: int = 1
    canonical: bool = False
    weighted: bool = False
    encoding: str = "default"

    def __post_init__(self) -> None:
        if not 1 <= self.k <= MAX_K:
            raise ValueError(f"k must be in 1..{MAX_K}, not {self.k}")
        if not 1 <= self.m <= min(self.k, 31):
            raise ValueError(f"m must be in 1..min(k, 31), not {self.m}")
        if self.encoding not in ALPHABETS:
            raise ValueError(f"encoding must be one of {sorted(ALPHABETS)}")

    @property
    def alphabet(self) -> str:
        return ALPHABETS[self.encoding]

    def as_dict(self) -> dict:
        return asdict(self) | {"version": list(VERSION)}
