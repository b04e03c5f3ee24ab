"""Column-level helpers: text, time, severity and the fixed values they rely on."""
