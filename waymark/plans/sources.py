"""Sources whose comments, strings and split lines hold what looks like declarations.

`§` stands for a key of the data. Each comes with the declarations it really has:
(language, line, name, type, full name).
"""

SOURCES = {
    "typescript": """/* class Ghost {
   function no() { */
export class T§ {
  // class Hidden {
  private note = "class Fake {";
  run = (x: number) => {
    return `}} ${x} class Tpl {
      const inside = 1`
  }
  async load(
    a: string,
    b = "{",
  ): Promise<void> {
    if (a) {
    }
  }
}
const after§ = '}';
""",
    "python": '''"""
class Ghost:
"""
class P§(
    Base,
):
    note = "def no():"
    def go(
        self,
    ):
        \'\'\'def hidden():
    def more(): \'\'\'
        return 1  # def gone():
''',
    "csharp": """// public class Ghost {
public class C§
{
    string s = @"C:\\";  // {
    /* public void No() { */
    public async Task<int> Load(
        int a,
        string b = "}")
    {
    }
    public void Next() {}
}
""",
    "go": """/*
func Ghost() {}
*/
func Go§(
	a int,
) {
	s := `
func Raw() {
`
}
type G§ struct {
}
""",
    "php": """<?php
# function ghost() {
class H§ {
  public function run(
    $a = "function no() {"
  ) {
  }
}
""",
    "java": '''/** class Ghost { */
class J§ {
  String t = """
    class Text {
    """;
  public static int sum(int a,
      int b) {
    return a;
  }
}
''',
    "cpp": """// class Ghost {
class K§ {
  char c = '{';
};
class L§ {
};
""",
    "ruby": """=begin
class Ghost
=end
class R§
  # def hidden
  def run
    "def no"
  end
end
""",
}

DECLARED = [
    ("typescript", 2, "T§", "class", "T§"),
    ("typescript", 4, "note", "property", "T§.note"),
    ("typescript", 5, "run", "property", "T§.run"),
    ("typescript", 9, "load", "method", "T§.load"),
    ("typescript", 17, "after§", "variable", "after§"),
    ("python", 3, "P§", "class", "P§"),
    ("python", 7, "go", "function", "P§.go"),
    ("csharp", 1, "C§", "class", "C§"),
    ("csharp", 5, "Load", "method", "C§.Load"),
    ("csharp", 10, "Next", "method", "C§.Next"),
    ("go", 3, "Go§", "function", "Go§"),
    ("go", 10, "G§", "class", "G§"),
    ("php", 2, "H§", "class", "H§"),
    ("php", 3, "run", "function", "H§.run"),
    ("java", 1, "J§", "class", "J§"),
    ("java", 5, "sum", "method", "J§.sum"),
    ("cpp", 1, "K§", "class", "K§"),
    ("cpp", 4, "L§", "class", "L§"),
    ("ruby", 3, "R§", "class", "R§"),
    ("ruby", 5, "run", "method", "R§.run"),
]

#: Endpoints over several lines, beside some in comments and strings.
CONTROLLER = """[Route(
    "api/[controller]")]  // [Route("no")]
[ApiController]
public class S§Controller : Base
{
    /* [HttpGet("ghost")]
       public void Ghost() {} */
    [HttpGet(
        "one")]
    [Authorize,
     HttpPost("two")]
    public IActionResult One(
        int id) { return Ok("[HttpGet] public void Two() {"); }

    string text = @"
    [HttpGet(""three"")]
    public void Three() {}
    ";
    [HttpDelete("four")]  public void Four() {}
}
"""
MINIMAL = """app.MapGet(
    "/one/§",
    async (int id) => { var s = "app.MapPut(\\"/no\\")"; });
// app.MapPost("/ghost", x);
/* app
  .MapPost("/ghost", x); */
group.MapPatch("/two", () => {
    other.MapDelete(
        $"/three", y);
});
"""
