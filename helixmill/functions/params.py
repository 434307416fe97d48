"""Parameters of a sketch and the selection threshold they imply."""

from __future__ import annotations

from dataclasses import dataclass, replace
from decimal import Decimal, localcontext

MAX_HASH = 2**64 - 1
#: Largest minimizer and k-mer sizes of the sketch format.
MAX_M, MAX_K = 15, 63
#: k-mers up to this size fit a BIGINT at two bits a base.
MAX_INT_K = 31


@dataclass(frozen=True)
class SketchParams:
    """k-mer size, minimizer size, subsampling rate, least abundance, and how the rate is turned into a threshold.

    ``mode`` is ``hitting`` (a k-mer is kept at about the rate 1/s) or
    ``fracminhash`` (a minimizer is kept at the rate 1/s).  ``order`` says which
    m-mer of a k-mer is its minimizer: that of least ``hash``, or with
    ``decycling`` of the best class of the decycling set, then of least hash.
    """

    k: int = 31
    m: int = 11
    s: float = 1000
    abundance: int = 1
    mode: str = "hitting"
    order: str = "hash"

    def normalised(self) -> SketchParams:
        """Sizes made odd by rounding up, then m held to its largest value."""
        k, m = self.k + (self.k % 2 == 0), self.m + (self.m % 2 == 0)
        m = min(m, MAX_M)
        if not 0 < m < k <= MAX_K:
            raise ValueError(f"need 0 < m < k <= {MAX_K}, got k={k}, m={m}")
        if self.mode not in ("hitting", "fracminhash"):
            raise ValueError(f"unknown mode {self.mode!r}")
        if self.order not in ("hash", "decycling"):
            raise ValueError(f"unknown order {self.order!r}")
        return replace(self, k=k, m=m)

    @property
    def counting(self) -> SketchParams:
        """The same with every k-mer abundant enough."""
        return replace(self, abundance=1)

    @property
    def window(self) -> int:
        """Minimizer candidates in a k-mer."""
        return self.k - self.m + 1

    @property
    def longest(self) -> int:
        """Length of a maximal super-k-mer."""
        return 2 * self.k - self.m

    def threshold(self) -> int:
        """Largest unsigned hash that is selected."""
        if self.s <= 1:
            return MAX_HASH
        with localcontext() as context:
            context.prec = 60
            s = Decimal(self.s)
            if self.mode == "fracminhash":
                return int(Decimal(MAX_HASH) / s)
            chance = 1 - (1 - 1 / s) ** (Decimal(1) / self.window)
            return 2 * int(chance * 2**63)


def ordered(unsigned: int) -> int:
    """An unsigned 64-bit number as the signed one of the same rank."""
    return unsigned - 2**63
