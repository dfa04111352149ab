"""Constants and defaults of the interval model."""

# Annotation type names, thresholds and window sizes that results depend on.
NUC, MSP, FIRE, M6A, CPG = "nuc", "msp", "fire", "m6a", "cpg"
MIN_MARK_QUALITY = 125
MIN_FIRE_QUALITY = 229
MIN_FIRE_COVERAGE = 4
PILEUP_WINDOW = 1_000_000
ROLLING_WINDOW = 200
SCORE_SCALE = 1_000_000
FIRE_COLORS = ((1.0, "139,0,0"), (2.0, "175,0,0"), (3.0, "200,0,0"), (4.0, "225,0,0"), (5.0, "255,0,0"), (10.0, "255,140,0"), (25.0, "225,225,0"), (100.0, "147,112,219"))
