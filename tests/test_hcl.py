"""HCL by its grammar: references by position, templates, heredocs, loops, dynamic blocks, and text that is no HCL."""

import pytest

from spanloom.sources import extractors, hcl


def refs(expression):
    (attribute,) = hcl.parsed(f"a = {expression}\n")
    return [r for r, _, _ in attribute.value.refs]


@pytest.mark.parametrize(
    ("expression", "expected"),
    [
        ("aws_s3_bucket.b.arn", ["aws_s3_bucket.b"]),
        ("data.aws_ami.x.id", ["data.aws_ami.x"]),
        ("module.net.vpc[0].id", ["module.net"]),
        ("aws_q.a[0].arn", ["aws_q.a"]),
        ("aws_q.a[*].arn", ["aws_q.a"]),
        ("aws_q.a.*.arn", ["aws_q.a"]),
        ('aws_q["k"].arn', []),  # an index comes before any name
        ("aws_q.a[aws_i.k.id].arn", ["aws_q.a", "aws_i.k"]),
        ("var.some_list.x", []),
        ("local.a_b.c", []),
        ("each.value.q_r", []),
        ("data.aws_ami", []),
        ("random.x", []),
        ('"aws_s3_bucket.b.arn"', []),
        ('"a ${aws_s3_bucket.b.arn} c"', ["aws_s3_bucket.b"]),
        ('"a $${aws_s3_bucket.b.arn} c"', []),
        (r'"a \" ${aws_a.b} \\${aws_c.d}"', ["aws_a.b", "aws_c.d"]),
        ('"${join(",", ["x", "${aws_a.b.c}"])}"', ["aws_a.b"]),
        ('"%{ if aws_a.b.on }${aws_c.d}%{ else }x%{ endif }"', ["aws_a.b", "aws_c.d"]),
        ('"%{ for my_x in aws_a.b ~}${my_x.id}${aws_c.d}%{ endfor }${my_x.id}"', ["aws_a.b", "aws_c.d", "my_x.id"]),
        ("<<EOF\naws_no.x \"${aws_a.b}\n  EOFS\nEOF", ["aws_a.b"]),
        ("<<-EOF\n  # ${aws_a.b}\n  EOF", ["aws_a.b"]),
        ("[for k, my_q in aws_a.all : my_q.arn if aws_c.d.on]", ["aws_a.all", "aws_c.d"]),
        ("{ for my_q in aws_a.all : my_q.id => my_q.arn... }", ["aws_a.all"]),
        ("[for s in my_s.all : s] == my_s.b", ["my_s.all", "my_s.b"]),
        ("{ a = aws_a.b, c : aws_c.d\n (aws_e.f.id) = 1 }", ["aws_a.b", "aws_c.d", "aws_e.f"]),
        ("{}", []),
        ("[\n  aws_a.b,  # aws_no.x\n  // aws_no.y\n  aws_c.d,\n]", ["aws_a.b", "aws_c.d"]),
        ("aws_a.b ? -aws_c.d : !aws_e.f", ["aws_a.b", "aws_c.d", "aws_e.f"]),
        ("1 + aws_a.b * (\n aws_c.d\n)", ["aws_a.b", "aws_c.d"]),
        ("my_fn(aws_a.b, aws_c.d...)", ["aws_a.b", "aws_c.d"]),
        ("my_fn(aws_a.b).out_put.x", ["aws_a.b"]),
        ("provider::aws_x::parse(aws_a.b)", ["aws_a.b"]),
        ("aws_a.b /* aws_no.x */", ["aws_a.b"]),
        ("3.5e2", []),
        ('"ünï ${aws_a.b}"', ["aws_a.b"]),
    ],
)
def test_references_of_an_expression(expression, expected):
    assert refs(expression) == expected


@pytest.mark.parametrize("text", ["a = ", "a = [1, 2", 'a = "x', "b {", "}", "a = <<EOF\nx\n", 'a = "${x"', 'r "${x}" {}', "a = 1 2", "a = {b 1}", 'a = "%{ endfor }"', 'a = "%{ for x in y }"', "= 1", "\0"])
def test_text_that_is_no_hcl(text):
    with pytest.raises(ValueError):
        hcl.parsed(text)
    assert [r[2] for r in extractors.rows_of("m.tf", text)] == ["gap"]


@pytest.mark.parametrize("text", ["", "\n\n# only a comment", "/* a\n b */", "\ufeffa = 1"])
def test_files_without_blocks_yield_nothing(text):
    assert extractors.rows_of("m.tf", text) == []


FILE = '''
# aws_no.x
resource "aws_sqs_queue" "ü" {
  name       = "n-${aws_kms_key.k.id}"
  depends_on = [aws_iam_role.r, module.net]
  tags       = { role = aws_iam_role.r.arn, self = aws_sqs_queue.other.arn }
  policy     = jsonencode({
    Statement = [{ Action = ["sqs:Send", "sqs:${var.x}"], "Actions" : "sqs:Get", NotAction = "iam:*" }]
  })
  doc = <<-EOT
    {"Action": "s3:*", "R": "${data.aws_caller.me.arn}"}
    EOT
  dynamic "redrive_rule" {
    for_each = aws_list.l.ids
    content {
      target = redrive_rule.value
      key    = aws_kms_key.k.arn
    }
  }
  dynamic "other_rule" {
    for_each = []
    iterator = own_it
    content { target = own_it.value }
  }
  lifecycle { ignore_changes = [tags] }
}
module net { source = "./net" }
output "o" { value = aws_no.y.id }
'''


def test_rows_of_a_file():
    rows = [r[2:] for r in extractors.rows_of("m.tf", FILE)]
    own = "aws_sqs_queue.ü"
    assert [r[:3] for r in rows if r[1] == own] == [
        ("resource", own, "aws_sqs_queue"),
        ("depends_on", own, "aws_iam_role.r"),
        ("depends_on", own, "module.net"),
        ("references", own, "aws_kms_key.k"),
        ("references", own, "aws_list.l"),
        ("references", own, "aws_sqs_queue.other"),
        ("references", own, "data.aws_caller.me"),
        ("attribute", own, "name aws_kms_key.k"),
        ("attribute", own, "depends_on aws_iam_role.r"),
        ("attribute", own, "depends_on module.net"),
        ("attribute", own, "tags aws_iam_role.r"),
        ("attribute", own, "tags aws_sqs_queue.other"),
        ("attribute", own, "doc data.aws_caller.me"),
        ("attribute", own, "redrive_rule.for_each aws_list.l"),
        ("attribute", own, "redrive_rule.key aws_kms_key.k"),
        ("action", own, "sqs:Send"),
        ("action", own, "sqs:Get"),
    ]
    assert [r[:3] for r in rows if r[1] == "module.net"] == [("module", "module.net", "./net")]
    assert len(rows) == 18
    text = FILE.encode()
    assert {text[r[3] : r[4]].decode() for r in rows if r[2].startswith("doc ")} == {"data.aws_caller.me.arn"}
    assert text[rows[0][3] : rows[0][4]].decode().startswith('resource "aws_sqs_queue"') and text[: rows[0][4]].endswith(b"}")


def test_long_and_deep_text():
    many = "".join(f'resource "aws_q" "q{i}" {{\n  a = "${{aws_q.q{i + 1}.id}}"\n}}\n' for i in range(5000))
    assert sum(r[2] == "references" for r in extractors.rows_of("m.tf", many)) == 5000
    assert [r[2] for r in extractors.rows_of("m.tf", "a = " + "[" * 100_000)] == ["gap"]
