"""Models whose answers SQL can foresee."""


def length_model():
    """Tells the prompt's length, with a ruler below that cleaning removes."""
    return lambda prompts, budgets: [f"Summary of {len(p)} characters.\n\n---\n" for p in prompts]


def odd_model():
    """Answers prompts of odd length only, as a record; fails on others."""
    return lambda prompts, budgets: [
        {"text": f"Odd {len(p)}"} if len(p) % 2 else "" for p in prompts
    ]


def budget_model():
    """Answers with its token budget, first in a list."""
    return lambda prompts, budgets: [[f"Budget {b}"] for b in budgets]


def talkative_model():
    """Labels, repeats and more sentences than wanted."""
    return lambda prompts, budgets: [
        f"Answer: It has {len(p)} characters. It has {len(p)} characters. Two. Three. Four. Five.\n```\n"
        for p in prompts
    ]


def broken_model():
    raise RuntimeError("no such model")
