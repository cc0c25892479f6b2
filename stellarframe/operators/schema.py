"""Names, bits and schemas of frames, stamps, solutions and catalogs."""

from __future__ import annotations

# Mask bits of a pixel and quality bits of a catalog entry.
MASK_BITS = {"bad": 1, "saturated": 2, "cosmic": 4, "nonfinite": 8, "edge": 16, "user": 32}
QUALITY_BITS = {"fwhm": 1, "dipole": 2, "masked": 4, "shape": 8, "near_bright": 16}
FWHM_PER_SIGMA = 2.3548200450309493
MAD_TO_SIGMA = 1.4826
#: Median of the chi-squared distribution with one degree of freedom.
MEDIAN_CHI2_1 = 0.4549364231195724

PIXELS = "frame_id string, y int, x int, value float, variance float, mask smallint"
STAMPS = "frame_id string, x int, y int, flux double, snr double, fwhm double"
SELECTED = "frame_id string, stamp int, x int, y int, fwhm_science double, fwhm_reference double"
SOLUTION = (
    "frame_id string, beta double, n_max int, radius int, knots array<double>, theta array<double>, n_components int, n_spatial int, "
    "lam double, gcv double, effective_dof double, rss double, component_sums array<double>, direction string, height int, width int, "
    "reduced_chi2 double, n_stamps_used int, n_stamps_rejected int, stamp_x array<int>, stamp_y array<int>, stamp_chi2 array<double>, "
    "stamp_accepted array<boolean>, n_pixels int, curve array<double>"
)
CATALOG = (
    "frame_id string, x double, y double, peak_x int, peak_y int, peak_snr double, n_pix int, flux double, expected_n_pix double, fwhm_ratio double, "
    "fwhm_consistent boolean, mask_flags smallint, is_dipole boolean, psf_chi2 double, psf_chi2_dof int, psf_amplitude double, psf_amplitude_err double, "
    "shape_consistent boolean, bright_star_dist double, near_bright_star boolean, quality smallint"
)
