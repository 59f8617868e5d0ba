"""Checksum and shape tests over a matched value."""

from __future__ import annotations


def digits_of(value: str) -> str:
    """The value without its non-digit characters (Unicode digits count as digits)."""
    return f"regexp_replace({value}, '(?U)\\\\D', '')"


def _dihedral_product(a: int, b: int) -> int:
    """Product in the dihedral group of order ten, elements 0-4 rotations and 5-9 reflections."""
    rotation = (a - b if a >= 5 else a + b) % 5
    return rotation + (5 if (a >= 5) != (b >= 5) else 0)


def _verhoeff_tables() -> tuple[str, str]:
    """SQL arrays: the group's product by state and digit, and the digit permutation by position and digit."""
    # Fixed value of the published scheme: the digit permutation applied once more per position.
    base = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)
    powers = [tuple(range(10))]
    while len(powers) < 8:
        powers.append(tuple(base[d] for d in powers[-1]))
    products = ", ".join(str(_dihedral_product(a, b)) for a in range(10) for b in range(10))
    return f"array({products})", f"array({', '.join(str(d) for row in powers for d in row)})"


_PRODUCTS, _PERMUTED = _verhoeff_tables()


def verhoeff_valid(digits: str) -> str:
    """Verhoeff check over an ASCII digit string, last digit being the check digit."""
    permuted = f"transform(split(reverse({digits}), ''), (digit, i) -> {_PERMUTED}[i % 8 * 10 + ascii(digit) - 48])"
    state = f"aggregate({permuted}, 0, (state, digit) -> {_PRODUCTS}[state * 10 + digit])"
    return f"CASE WHEN {digits} RLIKE '^[0-9]+$' THEN {state} = 0 ELSE false END"


def luhn_valid(digits: str) -> str:
    return f"luhn_check({digits})"


def iban_valid(value: str) -> str:
    """ISO 13616: country and check digits moved to the end, letters as 10..35, remainder 1 mod 97."""
    compact = f"upper(regexp_replace({value}, '[^A-Za-z0-9]', ''))"
    return (
        f"aggregate(split(concat(substring({compact}, 5), substring({compact}, 1, 4)), ''), 0, (acc, c) -> "
        "CASE WHEN c BETWEEN '0' AND '9' THEN (acc * 10 + ascii(c) - 48) % 97 ELSE (acc * 100 + ascii(c) - 55) % 97 END) = 1"
    )


def aadhaar_valid(digits: str, checksum: bool = True) -> str:
    """Twelve digits that pass the checksum; any twelve digits when ``checksum`` is off."""
    twelve = f"length({digits}) = 12"
    return f"({twelve} AND {verhoeff_valid(digits)})" if checksum else f"({twelve})"


def phone_length(digits: str) -> str:
    return f"length({digits}) BETWEEN 10 AND 13"


def looks_like_mobile(digits: str) -> str:
    return f"({digits} RLIKE '^[6-9][0-9]{{9}}$')"


def looks_like_aadhaar(digits: str) -> str:
    return f"({digits} RLIKE '^[2-9][0-9]{{11}}$' AND {verhoeff_valid(digits)})"
