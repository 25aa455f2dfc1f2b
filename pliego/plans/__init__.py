"""Composite jobs and the contract view over the driver's test tables."""
