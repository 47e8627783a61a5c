"""Fixed values of the detectors and texts. Prompts for visual models are inputs of `operators.vectors.contrast`."""

from __future__ import annotations

# AudioSet class numbers that count as action, of four fused signals.
AUDIO_LABELS = {
    427: "Gunshot, gunfire",
    428: "Machine gun",
    430: "Artillery fire",
    426: "Explosion",
    436: "Boom",
    466: "Bang",
    467: "Slap, smack",
    468: "Whack, thwack",
    469: "Smash, crash",
    470: "Breaking",
    472: "Whip",
    14: "Screaming",
    8: "Shout",
    11: "Yell",
    12: "Battle cry",
    38: "Groan",
    298: "Fire",
    458: "Arrow",
}
# Those that count beside them with three fused signals.
MORE_AUDIO_LABELS = {429: "Cap gun", 431: "Fusillade", 471: "Crushing", 473: "Thud", 143: "Horse gallop"}
# Kinetics class numbers that count as action.
ACTION_LABELS = {
    105: "drop kicking",
    150: "headbutting",
    152: "high kick",
    259: "punching person (boxing)",
    302: "side kick",
    314: "slapping",
    345: "sword fighting",
    395: "wrestling",
}
# Narration of segments with a score above 0.55, above 0.4, and below.
NARRATION_HIGH = (
    "Here we go.",
    "This is it.",
    "Watch this.",
    "Absolute chaos.",
    "No mercy.",
    "Total destruction.",
    "They never saw it coming.",
    "And just like that, it's over.",
)
NARRATION_MIDDLE = (
    "Things are heating up.",
    "Trouble ahead.",
    "This gets intense.",
    "Stay sharp.",
    "It's about to go down.",
    "The action picks up.",
)
NARRATION_LOW = (
    "And then...",
    "Meanwhile...",
    "The calm before the storm.",
    "Something's not right.",
)
# Callouts of intense segments and of others.
CALLOUTS_HIGH = ("CHAOS!", "BRUTAL!", "CARNAGE!", "NO MERCY!", "SAVAGE!")
CALLOUTS_MIDDLE = ("INTENSE!", "ACTION!", "FIGHT!", "SHOWDOWN!")


def labels(spark, numbers: dict[int, str]):
    """A label set as (label_id, name)."""
    return spark.createDataFrame(sorted(numbers.items()), "label_id int, name string")
