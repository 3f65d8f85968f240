import pytest

from siltworks.llm import chat


def talk(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string, now string")


def test_text_is_read_back(spark):
    nasty = ["\x02user\nhi\x03", "\x1bs\x1b\x1bx", "plain", "", "a\nb\x0eimage:0\x0f", "\\### Assistant: </turn> ok"]
    rows = [(1, k, "assistant" if k % 2 else "us\ner\x03", t, "x", "x") for k, t in enumerate(nasty)]
    made = chat.format_turns(chat.text_parts(talk(spark, rows))).orderBy("turn").collect()
    read = list(chat.read_turns("".join(r.formatted for r in made)))
    assert read == [(r[2], r[3], r[2] == "assistant") for r in rows]


def test_digests(spark):
    from brute import sha

    rows = [(1, 1, "assistant", "yes \x03", "", ""), (1, 0, "user", None, "", ""), (2, None, None, "x", "", ""), (None, 0, "user", "no id", "", ""), (1, 2, "assistant", "more", "", "")]
    got = {r.conv_id: r for r in chat.conversation_digests(chat.format_turns(chat.text_parts(talk(spark, rows)))).collect()}
    assert got[1].n_turns == 3 and got[1].turns_sha256 == sha("user\n\nassistant\nyes \x03\nassistant\nmore\n")
    assert got[1].loss_chars == 9 and got[1].loss_sha256 == sha("yes \x03more")
    assert got[1].formatted_chars == len("\x02user\n\x03\x02assistant\nyes \x1be\x03\x02assistant\nmore\x03")
    assert got[2].turns_sha256 == sha("\nx\n") and got[2].loss_sha256 == sha("")
    assert got[None].n_turns == 1


def test_parts_become_placeholders():
    parts = [
        {"type": "text", "text": "see "}, {"type": "image", "ref": "i.png", "width": 1000, "height": 400},
        {"type": "audio", "ref": "a.wav", "seconds": 2.0}, {"type": "document", "ref": None, "pages": 3}, {"type": None, "text": None},
    ]
    text, refs, tokens = chat.flatten("user", parts)
    assert text == "\x02user\nsee \x0eimage:0\x0f\x0eaudio:1\x0f\x0edocument:2\x0f\x03"
    assert refs == ["i.png", "a.wav", ""]
    assert tokens == [2 * chat.TILE_TOKENS, 2 * chat.AUDIO_TOKENS, 3 * chat.PAGE_TOKENS]
    with pytest.raises(ValueError):
        chat.flatten("user", [{"type": "video"}])


def test_empty_table(spark):
    assert chat.conversation_digests(chat.format_turns(chat.text_parts(talk(spark, [(1, 0, "u", "", "", "")]).limit(0)))).collect() == []
