"""Constants, thermodynamics and wind as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# SI units.
NA = 6.02214076e23
KB = 1.380649e-23
RHO_WATER = 997.0
GAMMA_DRY = 9.8e-3
C_LIQUID = 4186.0
CV = 718.0
L_FUSION = 3.337e5
L_VAPOR = 2.501e6
L_SUBLIMATION = L_VAPOR + L_FUSION
PLANCK = 6.62607015e-34
EARTH_RADIUS = 6.371e6
LIGHT = 299792458.0
STEFAN_BOLTZMANN = 5.67e-8
RD = 287.05
RV = 461.5
G = 9.81
CP = 1005.0
EPSILON = RD / RV
R_STAR = KB * NA
P0 = 1e5
STANDARD = {"T": 288.15, "p": 101325.0, "rho": 1.225, "z": 0.0}
#: Lambert rotation: sine of the cone, central longitude, radians a degree
ROTATION = (0.622515, -97.5, 0.017453)


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def potential_temperature(t, p, p0: float = P0) -> Column:
    return _c(t) * F.pow(p0 / _c(p), F.lit(RD / CP))


def inverse_potential_temperature(p, theta, p0: float = P0) -> Column:
    return _c(theta) * F.pow(_c(p) / p0, F.lit(RD / CP))


def virtual_temperature(t, q) -> Column:
    return _c(t) * (1 + 0.61 * _c(q))


def saturation_pressure(t, ice: bool = False) -> Column:
    a, b = (3.41e11, -6130.0) if ice else (2.53e11, -5420.0)
    return a * F.exp(b / _c(t))


def temperature_from_vapor(e) -> Column:
    return -5420.0 / F.ln(_c(e) / 2.53e11)


def mixing_ratio(e, p) -> Column:
    return EPSILON * _c(e) / _c(p)


def ideal_gas(solve_for: str, **known: Column | str | float) -> Column:
    """p, V, T, rho, m or n of a gas: pV = nR*T with n, or p = rho R T and pV = mRT with the gas constant R (dry air)."""
    k = {x: _c(v) for x, v in known.items() if v is not None}
    r = k.get("R", F.lit(RD))
    if "N" in k:
        k["n"] = k["N"] / NA
    if "alpha" in k:
        k["rho"] = 1 / k["alpha"]
    have = set(k)
    amount = k["n"] * R_STAR if "n" in have else k["m"] * r if "m" in have else None
    forms = {
        "p": lambda: amount * k["T"] / k["V"] if amount is not None else k["rho"] * r * k["T"],
        "V": lambda: amount * k["T"] / k["p"],
        "T": lambda: k["p"] * k["V"] / amount if amount is not None else k["p"] / (k["rho"] * r),
        "rho": lambda: k["p"] / (r * k["T"]),
        "m": lambda: k["p"] * k["V"] / (r * k["T"]),
        "n": lambda: k["p"] * k["V"] / (R_STAR * k["T"]),
        "N": lambda: k["p"] * k["V"] / (KB * k["T"]),
    }
    if solve_for not in forms:
        raise ValueError(f"can't solve for {solve_for}")
    return forms[solve_for]()


def hypsometric(solve_for: str, **known: Column | str | float) -> Column:
    """deltaz, Tv, p1, p2, Z1 or Z2 from the others (Z2 - Z1 = deltaz = Rd Tv / g ln(p1 / p2))."""
    k = {x: _c(v) for x, v in known.items() if v is not None}
    dz = k["deltaz"] if "deltaz" in k else k["Z2"] - k["Z1"] if {"Z1", "Z2"} <= set(k) else None
    thick = lambda: RD * k["Tv"] / G * F.ln(k["p1"] / k["p2"])
    forms = {
        "deltaz": thick,
        "Tv": lambda: dz * G / (RD * F.ln(k["p1"] / k["p2"])),
        "p1": lambda: k["p2"] * F.exp(dz * G / (RD * k["Tv"])),
        "p2": lambda: k["p1"] * F.exp(-dz * G / (RD * k["Tv"])),
        "Z1": lambda: k["Z2"] - thick(),
        "Z2": lambda: k["Z1"] + thick(),
    }
    if solve_for not in forms:
        raise ValueError(f"can't solve for {solve_for}")
    return forms[solve_for]()


def wind_components(speed, direction) -> tuple[Column, Column]:
    """u and v of wind that comes from a direction."""
    a = F.radians(_c(direction))
    return -_c(speed) * F.sin(a), -_c(speed) * F.cos(a)


def wind_direction(u, v) -> Column:
    """Where wind comes from. F.atan2 drops the signs of zeros; of calm wind IEEE's atan2 keeps them: 90 if u is -0.0."""
    u, v = _c(u), _c(v)
    calm = (u == 0) & (v == 0) & (F.pow(u, F.lit(-1.0)) < 0)
    return F.when(calm, F.lit(90.0)).otherwise(F.pmod(270 - F.degrees(F.atan2(v, u)), F.lit(360.0)))


def unit_vector(u, v) -> tuple[Column, Column]:
    s = F.sqrt(_c(u) ** 2 + _c(v) ** 2)
    return F.try_divide(_c(u), s), F.try_divide(_c(v), s)


def rotate_to_earth(u, v, lon) -> tuple[Column, Column]:
    sine, centre, rad = ROTATION
    a = sine * (_c(lon) - centre) * rad
    return F.cos(a) * _c(u) + F.sin(a) * _c(v), -F.sin(a) * _c(u) + F.cos(a) * _c(v)


def hybrid_pressure(at, bt, surface) -> Column:
    """Pressure in hPa of a hybrid-sigma level."""
    return (_c(at) + _c(bt) * _c(surface)) / 100


# Standard atomic weights (g mol-1).
ATOMIC = {"H": 1.008, "C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998, "S": 32.06, "Cl": 35.45, "Br": 79.904, "P": 30.974, "Si": 28.085, "I": 126.904, "Na": 22.990, "K": 39.098, "Ca": 40.078}
# Factors to kg, mol, m, s.
MASS = {"kg": 1.0, "g": 1e-3, "mg": 1e-6, "ug": 1e-9, "Mg": 1e3, "Gg": 1e6, "Tg": 1e9, "t": 1e3}
SUBSTANCE = {"mol": 1.0, "mmol": 1e-3, "umol": 1e-6, "nmol": 1e-9, "molec": 1 / 6.02214076e23}
LENGTHS = {"m": 1.0, "km": 1e3, "cm": 1e-2}
TIMES = {"s": 1.0, "min": 60.0, "hr": 3600.0, "h": 3600.0, "d": 86400.0, "a": 365.25 * 86400.0}


def molecular_weight(formula: str) -> float:
    """g mol-1 of a formula such as CH4, CCl4 or Ca(OH)2."""
    import re

    def total(s: str) -> float:
        while m := re.search(r"\(([A-Za-z0-9]+)\)(\d*)", s):
            s = s[: m.start()] + m[1] * int(m[2] or 1) + s[m.end() :]
        parts = re.findall(r"([A-Z][a-z]?)(\d*)", s)
        if "".join(a + n for a, n in parts) != s or not parts:
            raise ValueError(f"not a formula: {formula}")
        return sum(ATOMIC[a] * int(n or 1) for a, n in parts)

    return total(formula)


def flux_factor(src: str, dst: str, formula: str | None = None) -> float:
    """The factor from one flux unit (amount, area, time: 'kg km-2 d-1') to another; mass and substance by the formula."""

    def parse(unit: str) -> tuple[str, float, float]:
        kind, value, scale = "", 1.0, 1.0
        for part in unit.split():
            name, sign, power = part.partition("-")
            p = -int(power) if sign else 1
            if name in MASS and p == 1 and not kind:
                kind, value = "mass", MASS[name]
            elif name in SUBSTANCE and p == 1 and not kind:
                kind, value = "substance", SUBSTANCE[name]
            elif name in LENGTHS:
                scale *= LENGTHS[name] ** p
            elif name in TIMES:
                scale *= TIMES[name] ** p
            else:
                raise ValueError(f"unknown unit {part!r}")
        if not kind:
            raise ValueError(f"no amount in {unit!r}")
        return kind, value, scale

    (k1, v1, s1), (k2, v2, s2) = parse(src), parse(dst)
    mw = molecular_weight(formula) / 1e3 if formula else None
    if k1 != k2 and mw is None:
        raise ValueError("a formula is needed between mass and substance")
    cross = 1.0 if k1 == k2 else (mw if k1 == "substance" else 1 / mw)
    return v1 * s1 * cross / (v2 * s2)


def split_units(unit: str) -> tuple[str, str, str]:
    parts = tuple(x.strip() for x in unit.split("/"))
    if len(parts) != 3:
        raise ValueError("expected quantity/area/time")
    return parts  # type: ignore[return-value]


def blackman(n: int) -> list[float]:
    return [0.42 - 0.5 * math.cos(2 * math.pi * i / (n - 1)) + 0.08 * math.cos(4 * math.pi * i / (n - 1)) if n > 1 else 1.0 for i in range(n)]
