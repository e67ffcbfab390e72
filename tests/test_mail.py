"""Mail files of any kind give rows, never errors."""

from tallyspark.sources import messages

SOUND = b"From: a@b\r\nSubject: =?utf-8?q?caf=C3=A9?=\r\nMessage-ID: <1@x>\r\nDate: Mon, 20 May 2024 10:00:00 +0530\r\n\r\nhello"
MAILS = {
    "sound": SOUND,
    "charset": b"From: a@b\r\nContent-Type: text/plain; charset=no-such-set\r\n\r\nold \xe9 text",
    "broken parts": b"From: a@b\r\nContent-Type: multipart/mixed; boundary=cut\r\n\r\nno part at all",
    "broken header": b"From: =?x?=\xff<\r\nDate: never\r\nContent-Type: ;;;\r\n\r\nbody",
    "broken coding": b"From: a@b\r\nContent-Type: text/plain\r\nContent-Transfer-Encoding: base64\r\n\r\n%%%",
    "nested": b"From: a@b\r\nContent-Type: multipart/mixed; boundary=c\r\n\r\n--c\r\nContent-Type: text/html\r\n\r\n<p>hi</p>\r\n--c\r\nContent-Type: message/rfc822\r\n\r\nFrom: in@side\r\nContent-Type: multipart/mixed; boundary=d\r\n\r\n--d\r\nContent-Type: application/pdf\r\nContent-Disposition: attachment; filename=in.pdf\r\nContent-Transfer-Encoding: base64\r\n\r\nQUJD\r\n--d--\r\n--c\r\nContent-Disposition: attachment\r\n\r\nraw\r\n--c--\r\n",
    "no mail": b"\x00\x01\x02",
    "empty": b"",
}


def test_every_file_gives_a_row(spark):
    files = spark.createDataFrame([(k, bytearray(v)) for k, v in MAILS.items()] + [("null", None)], "path string, content binary")
    got = {r.path: r for r in messages.parsed_mail(files).collect()}
    assert len(got) == len(MAILS) + 1
    assert (got["sound"].subject, got["sound"].message_id, got["sound"].body, got["sound"].received_at.hour) == ("café", "<1@x>", "hello", 4)
    assert got["charset"].body.startswith("old ") and got["broken header"].received_at is None
    assert got["nested"].body.strip() == "<p>hi</p>" and list(got["nested"].attachments) == ["in.pdf", ""]
    for k in ("no mail", "empty", "null"):
        assert got[k].sender is None and got[k].body is None


def test_attachments_are_rows(spark):
    files = spark.createDataFrame([(k, bytearray(v)) for k, v in MAILS.items()] + [("null", None)], "path string, content binary")
    got = [(r.path, r.part, r.name, r.size, bytes(r.content)) for r in messages.mail_attachments(files).collect()]
    assert sorted(got) == [("nested", 0, "in.pdf", 3, b"ABC"), ("nested", 1, "", 3, b"raw")]
