"""Fixed values. They must equal published constants for results to agree."""

# Imaginary parts of the first ten non-trivial zeros of the zeta function.
ZETA_ZEROS = (
    14.134725141734694, 21.022039638771555, 25.010857580145689, 30.424876125859513, 32.935061587739190,
    37.586178158825671, 40.918719012147495, 43.327073280914999, 48.005150881167160, 49.773832477672302,
)

# CIE 1931 two-degree observer, 380..780 nm in steps of 10 nm.
OBSERVER_X = (
    0.0014, 0.0042, 0.0143, 0.0435, 0.1344, 0.2839, 0.3483, 0.3362, 0.2908, 0.1954,
    0.0956, 0.032, 0.0049, 0.0093, 0.0633, 0.1655, 0.2904, 0.4334, 0.5945, 0.7621,
    0.9163, 1.0263, 1.0622, 1.0026, 0.8544, 0.6424, 0.4479, 0.2835, 0.1649, 0.0874,
    0.0468, 0.0227, 0.0114, 0.0058, 0.0029, 0.0014, 0.0007, 0.0003, 0.0002, 0.0001, 0.0,
)
OBSERVER_Y = (
    0.0, 0.0001, 0.0004, 0.0012, 0.004, 0.0116, 0.023, 0.038, 0.06, 0.091,
    0.139, 0.208, 0.323, 0.503, 0.71, 0.862, 0.954, 0.995, 0.995, 0.952,
    0.87, 0.757, 0.631, 0.503, 0.381, 0.265, 0.175, 0.107, 0.061, 0.032,
    0.017, 0.0082, 0.0041, 0.0021, 0.001, 0.0005, 0.0003, 0.0001, 0.0001, 0.0, 0.0,
)
OBSERVER_Z = (
    0.0065, 0.0201, 0.0679, 0.2074, 0.6456, 1.3856, 1.7471, 1.7721, 1.6692, 1.2876,
    0.813, 0.4652, 0.272, 0.1582, 0.0782, 0.0422, 0.0203, 0.0087, 0.0039, 0.0021,
    0.0017, 0.0011, 0.0008, 0.0003, 0.0002, 0.0, 0.0, 0.0, 0.0, 0.0,
    0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0,
)

# Guards against division by zero and logarithm of zero, as the published features use them.
EPS = 1e-15
TINY = 1e-30
