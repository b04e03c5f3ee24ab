"""Readers and writers. Each returns or takes a DataFrame; none looks at the data on the driver."""
