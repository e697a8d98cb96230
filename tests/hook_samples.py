"""Hooks for the tests."""


def lengths(values):
    return [len(v) for v in values]


def numbers(values):
    return [int(v) for v in values]
