"""Column expressions: 2-bit codec, record widths and planning bounds."""
