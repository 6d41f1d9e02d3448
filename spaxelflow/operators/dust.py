"""Dust: column densities, dust-to-gas ratios, extinction curves."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import running_sum

# G in a solar mass, cm in a kpc, solar oxygen abundance.
MSUN_G, KPC_CM, X_SOLAR = 1.989e33, 3.08568e21, 8.69
# The places of hydrogen and oxygen in the array of metal fractions.
ABUNDANCES = {"h_frac": 0, "o_frac": 4}
# Fixed values of the fits log(G/D) = a + alpha (x_sol - x): free slope (a, alpha); broken (a, alpha_h, b, alpha_l, x_t).
FREE_SLOPE = {"MW": (2.21, 1.62), "Z": (2.21, 2.02)}
BROKEN = {"MW": (2.21, 1.00, 0.68, 3.08, 7.96), "Z": (2.21, 1.00, 0.96, 3.10, 8.10)}


def column_density(gas: DataFrame, value: str, by: tuple[str, ...] = ("galaxy_id", "spaxel"), order: tuple[str, ...] = ("z",), rows_a_piece: int | None = None) -> DataFrame:
    """Adds `column`, the sum of `value` along z, each cell's own included."""
    return running_sum(gas, tuple(by), tuple(order), value, "column", rows_a_piece)


def with_abundances(gas: DataFrame) -> DataFrame:
    """Gas with h_frac and o_frac: as they are, or else the first and fifth of the mass fractions `metals`."""
    absent = [c for c in ABUNDANCES if c not in gas.columns]
    if absent and "metals" not in gas.columns:
        raise ValueError(f"gas has neither metals nor {absent}")
    return gas.withColumns({c: F.get("metals", F.lit(ABUNDANCES[c])) for c in absent})


def oxygen_abundance(oxygen: Column, hydrogen: Column) -> Column:
    return 12 + F.log10(oxygen / (16 * hydrogen))


def dust_to_gas(oh: Column, model: str = "broken power law fit", xco: str = "Z") -> Column:
    if model == "power law slope free":
        a, alpha = FREE_SLOPE[xco]
        return F.pow(F.lit(10.0), -(a + alpha * (X_SOLAR - oh)))
    if model != "broken power law fit":
        raise NotImplementedError(model)
    a, high, b, low, turn = BROKEN[xco]
    return F.when(oh > turn, F.pow(F.lit(10.0), -(a + high * (X_SOLAR - oh)))).otherwise(F.pow(F.lit(10.0), -(b + low * (X_SOLAR - oh))))


def visual_extinction(sigma: Column, grain_density: float = 3.5, wave: float = 5448.0) -> Column:
    """A_V of a dust column in Msun / kpc^2."""
    return sigma * (3 * math.pi * MSUN_G / KPC_CM**2 / (0.4 * math.log(10) * wave * 1e-8 * grain_density))


# Coefficients of the published extinction curves, ascending powers.
CCM_OPT_A = (1.0, 0.17699, -0.50447, -0.02427, 0.72085, 0.01979, -0.77530, 0.32999)
CCM_OPT_B = (0.0, 1.41338, 2.28305, 1.07233, -5.38434, -0.62251, 5.30260, -2.09002)
CCM_FUV_A = (-1.073, -0.628, 0.137, -0.070)
CCM_FUV_B = (13.670, 4.257, -0.420, 0.374)
G23_IR = {"scale": 0.38526, "alpha": 1.68467, "alpha2": 0.78791, "centre": 4.30578, "width": 4.78338, "silicates": ((0.06652, 9.8434, 2.21205, -0.24703), (0.0267, 19.58294, 17.0, -0.27))}
G23_IR_B = (-1.01251, -1.06099)
G23_OPT_A = ((-0.35848, 0.7122, 0.08746, -0.05403, 0.00674), ((0.03893, 2.288, 0.243), (0.02965, 2.054, 0.179), (0.01747, 1.587, 0.243)))
G23_OPT_B = ((0.12354, -2.68335, 2.01901, -0.39299, 0.03355), ((0.18453, 2.288, 0.243), (0.19728, 2.054, 0.179), (0.1713, 1.587, 0.243)))
G23_UV_A = (0.81297, 0.2775, 1.06295, 0.11303, 4.60, 0.99)
G23_UV_B = (-2.97868, 1.89808, 3.10334, 0.65484, 4.60, 0.99)


def polynomial(x: Column, coefficients) -> Column:
    out = F.lit(float(coefficients[-1]))
    for c in reversed(coefficients[:-1]):
        out = out * x + float(c)
    return out


def ccm89(x: Column, rv: float = 3.1, x_unit: str = "reference") -> Column:
    """A(x)/A(V). x_unit: `wavenumber` (1/micron, the published curve), `reference` (x as it comes), `micron`."""
    x = 1 / x if x_unit == "micron" else x
    # Fixed values of the published curve, here and in the two tables above.
    y, far = x - 1.82, F.greatest(x - 5.9, F.lit(0.0))
    a_nuv = 1.752 - 0.316 * x - 0.104 / ((x - 4.67) * (x - 4.67) + 0.341) + far * far * (-0.04473 - 0.009779 * far)
    b_nuv = -3.09 + 1.825 * x + 1.206 / ((x - 4.62) * (x - 4.62) + 0.263) + far * far * (0.2130 + 0.1207 * far)
    ir = F.pow(x, F.lit(1.61))
    return (
        F.when((x >= 0.3) & (x < 1.1), ir * (0.574 - 0.527 / rv))
        .when((x >= 1.1) & (x < 3.3), polynomial(y, CCM_OPT_A) + polynomial(y, CCM_OPT_B) / rv)
        .when((x >= 3.3) & (x <= 8.0), a_nuv + b_nuv / rv)
        .when((x > 8.0) & (x <= 10.0), polynomial(x - 8.0, CCM_FUV_A) + polynomial(x - 8.0, CCM_FUV_B) / rv)
        .otherwise(0.0)
    )


def smoothstep(x: Column, lo: float, hi: float) -> Column:
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - lo) / (hi - lo)))
    return t * t * (3 - 2 * t)


def drude(x: Column, amplitude: float, centre: float, fwhm: float | Column) -> Column:
    g = fwhm / F.lit(centre)
    d = x / centre - centre / x
    return amplitude * g * g / (d * d + g * g)


def modified_drude(x: Column, amplitude: float, centre: float, fwhm: float, asymmetry: float) -> Column:
    return drude(x, amplitude, centre, 2.0 * fwhm / (1 + F.exp(asymmetry * (x - centre))))


def power_law(x: Column, amplitude: float, alpha: float, x0: float = 1.0) -> Column:
    return amplitude * F.pow(x / x0, F.lit(-alpha))


def fm90(x: Column, c1: float = 0.10, c2: float = 0.70, c3: float = 3.23, c4: float = 0.41, xo: float = 4.59, gamma: float = 0.95) -> Column:
    far = F.greatest(x - 5.9, F.lit(0.0))  # fixed values, as the defaults: the published far-ultraviolet term
    d = x * x - xo * xo
    return c1 + c2 * x + c3 * x * x / (d * d + x * x * gamma**2) + c4 * far * far * (0.5392 + 0.05644 * far)


def gordon23(x: Column, rv: float = 3.1) -> Column:
    """A(x)/A(V) over micron; regions 0.09 - 0.3 - 0.33 - 0.9 - 1.1 - 35 with smooth steps on the overlaps."""
    s = G23_IR
    ratio = s["centre"] ** (s["alpha2"] - s["alpha"])
    step = smoothstep(x, s["centre"] - s["width"] / 2, s["centre"] + s["width"] / 2)
    ir_a = power_law(x, s["scale"], s["alpha"]) * (1 - step) + power_law(x, s["scale"] * ratio, s["alpha2"]) * step
    for k in s["silicates"]:
        ir_a = ir_a + modified_drude(x, *k)
    ir_b = power_law(x, *G23_IR_B)

    def optical(parts):
        out = polynomial(1 / x, parts[0])
        for k in parts[1]:
            out = out + drude(1 / x, *k)
        return out

    def curve(ir, opt, uv):
        blue, red = smoothstep(x, 0.3, 0.33), smoothstep(x, 0.9, 1.1)
        return (
            F.when((x >= 0.09) & (x < 0.3), uv)
            .when((x >= 0.3) & (x <= 0.33), (1 - blue) * uv + blue * opt)
            .when((x > 0.33) & (x < 0.9), opt)
            .when((x >= 0.9) & (x <= 1.1), (1 - red) * opt + red * ir)
            .when((x > 1.1) & (x < 35.0), ir)
            .otherwise(0.0)
        )

    a = curve(ir_a, optical(G23_OPT_A), fm90(1 / x, *G23_UV_A))
    b = curve(ir_b, optical(G23_OPT_B), fm90(1 / x, *G23_UV_B))
    return a + b * (1 / rv - 1 / 3.1)


def extinguish(curve: Column, av: Column | float | None = None, ebv: Column | float | None = None, rv: float = 3.1) -> Column:
    if av is None and ebv is None:
        raise ValueError("av or ebv is needed")
    return F.pow(F.lit(10.0), -0.4 * curve * (av if av is not None else rv * ebv))


def attenuate(stars: DataFrame, curve: Column, av: str = "av") -> DataFrame:
    """flux times the transmission of each star's A_V; `curve` is an array column, the same for all."""
    return stars.withColumn("flux", F.zip_with("flux", curve, lambda f, k: f * F.pow(F.lit(10.0), -0.4 * k * F.col(av))))
