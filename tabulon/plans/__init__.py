"""Named query plans over the driver tables, their SQL oracles, and flows."""
