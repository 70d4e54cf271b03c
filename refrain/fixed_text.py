"""Prompt wording whose exact text is part of the results."""

# Writing directives, one line of each bank per response.
OPENING_ANGLES = [
    "Open by painting the mood or atmosphere this track evokes from the very first second.",
    "Open by describing what you actually hear: the instrumentation, the production texture, the way the elements interlock.",
    "Open by naming the track and artist immediately, then hook with the single most distinctive quality.",
    "Open by placing the track in its scene or era — when it was made, what was happening musically around it.",
    "Open by addressing the listener directly — what specifically about their request this answers.",
    "Open with a sonic image: the way the song unfolds in time, what catches the ear first.",
    "Open with the lyrical or thematic angle: what the song is about, what it makes you feel without naming the feeling.",
    "Open with a comparison or lineage: which artist or scene this track descends from, or what it predicts.",
    "Open by setting a scene where this track plays — a specific time of day, a specific kind of room.",
    "Open with a hook from the track itself — a famous line, a riff, a moment listeners single out.",
    "Open by naming the genre and what this artist does with it that no one else quite does.",
    "Open with what makes this track stand out from the listener's recent reference points.",
]
CLOSING_FORMATS = [
    "Close with a vivid, specific scene tied to the track — a moment, a setting, a mental image the song unlocks.",
    "Close with a concrete follow-up recommendation: name a specific album, artist, or track that pairs naturally with this one.",
    "Close with a challenge: invite the listener to explore a related genre, scene, or era they haven't touched.",
    "Close with a question rooted in the listener's personal world — their city, a memory, an experience that maps to this song.",
    "Close with a cultural reference that opens a door — a film, a book, a piece of art that shares this track's spirit.",
    "Close by zooming in on one specific moment in the track — a transition, a lyric, a sonic detail worth pointing at.",
    "Close with what to listen for next time — a layer or detail that rewards a second listen.",
]
BODY_STRUCTURES = [
    "In the body, lead with the specific production choices and how they shape the listening experience.",
    "In the body, trace the emotional arc of the track — how it builds, where it pivots, what it leaves with you.",
    "In the body, zoom in on one specific moment in the track — a riff, a rhythmic detail, a vocal turn — and unpack why it works.",
    "In the body, weave the artist's lineage and what this track inherits from them.",
    "In the body, contrast this track with adjacent tracks the listener might know, sharpening what makes it distinctive.",
    "In the body, foreground the lyrical content and how the vocal delivery shapes its meaning.",
]
VOCAB_BY_AGE = {
    "13-17": "Use informal, high-energy language — the kind you would use telling a friend about a track that just blew your mind.",
    "18-24": "Use informal, culturally aware language — enthusiastic and specific, like a peer who knows their music deeply.",
    "25-34": "Use the language of a knowledgeable music enthusiast — direct, engaged, peer-to-peer.",
    "35-49": "Write with warm authority — someone who has lived with music long enough to place it in context.",
    "50+": "Write with the depth of someone who has followed music across decades — reference legacy, cultural context.",
}
TONAL_HH = "Be specific and discerning — be precise, use technical vocabulary where it earns its place."
TONAL_HL = "Be engaged but open — balance warmth with musical knowledge, avoid overload."
TONAL_LH = "Be in discovery mode but adventurous — suggest new directions with confidence."
TONAL_LL = "Be broadly open — keep your language accessible and welcoming, avoid jargon."

# Addenda to the system prompt.
PACKET_INTRO = (
    "Structural directives for this response — apply these within the WHY + personalization "
    "framework above, not instead of it:"
)
MIN_WORDS = (
    "Your response must be at least {n} words. Never write a short answer — every "
    "recommendation needs enough space to cover the WHY, the personal connection, and a meaningful closing."
)
BEGIN_DIRECTLY = (
    "Begin your response directly with the recommendation text. Do not echo, repeat, or "
    "reference the track metadata string below."
)
TRACK_HEADER = "Track to recommend for this listener:\n"
OVERUSED_PREFIX = "IMPORTANT — these bigrams are overused across the session set, avoid them: "
TEMPORAL_PREFIX = "Where relevant, ground your writing in the "
TEMPORAL_SUFFIX = "s — the era this track comes from."
GROUNDING_DIRECTIVE = (
    "\n\nGround the WHY in the track's SPECIFIC musical qualities listed below (genre, mood, "
    "instrumentation, era) — name the concrete quality that fits the request, not generic praise; "
    "ignore any junk tags."
)
CLOSING_TURN = "Respond now."
EDITOR_PROMPT = "You are an expert editor."
CRITIC_PROMPT = """You are a critic and editor. Your job: improve the following music recommendation response by:
1. Removing AI-helpdesk phrases ("Absolutely", "Sure", "I think", "Honestly")
2. Removing filler ("isn't just", "perfect blend", "sonic landscape")
3. Tightening repetitive sentences
4. Keeping the response at least 120 words
5. Keeping the recommendation, the personalization, and the music knowledge intact

DO NOT shorten dramatically. DO NOT change the recommended track. Output ONLY the refined response, no preamble."""
